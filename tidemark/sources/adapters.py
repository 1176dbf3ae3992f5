"""Logical inputs (ticks, bars, trades, journal) as projections of the tables there are.

Prices and returns are kept as whole hundredths beside their decimal values, so
that sums do not depend on the order of a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths of the trigger and the primary bars in seconds: one to five, as minute and five-minute bars are.
TRIGGER, PRIMARY = 3600, 18000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp, in UTC."""
    return F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts)


def normalised_epoch(value: Column) -> Column:
    """Seconds from what may be milliseconds: values over 10^10 are."""
    return F.when(value > 10_000_000_000, F.floor(value / 1000)).otherwise(value).cast("long")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, epoch_s, seq (order of arrival), price and cents."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", epoch("ts").alias("epoch_s"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def bars(spark: SparkSession, sf_dir: str, seconds: int = TRIGGER) -> DataFrame:
    """Bars of a length over the ticks: symbol, epoch_s, open, high, low, close, tick_volume, spread."""
    from tidemark.operators.bars import aggregate

    b = aggregate(ticks(spark, sf_dir), seconds)
    return b.withColumn("spread", F.floor(F.col("high") - F.col("low")) / 100)  # wider when prices move, as ticks have no ask


def _ledger(rows: DataFrame, key: str, order: str, start: Column, value: str, user: str) -> DataFrame:
    h = (F.round(F.col(value) * 100).cast("long") % 401 - 200).alias("r_h")
    entry = epoch(start).alias("entry_time")
    hold = (1 + F.col(user) % 60).cast("long").alias("holding_minutes")
    return rows.select(
        F.col(key).alias("trade_id"),
        F.when(F.col(key) % 2 == 0, "LONG").otherwise("SHORT").alias("direction"),
        entry,
        F.col(order).alias("seq"),
        (7 + F.col(key) % 4).cast("int").alias("strength"),
        h,
        hold,
    ).withColumns({"exit_time": F.col("entry_time") + 60 * F.col("holding_minutes"), "r": (F.col("r_h") / 100.0), "pnl": F.col("r_h"), "result": F.when(F.col("r_h") > 100, "TP2").when(F.col("r_h") > 0, "TP1").when(F.col("r_h") < -100, "STOP_LOSS").otherwise("EXPIRED"), "day": F.floor(F.col("entry_time") / 86400)})


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of one month: one trade an event.

    trade_id, direction, entry_time, exit_time (seconds), seq (total order),
    strength, r and r_h (its hundredths), pnl (dollars at 100 a unit of risk),
    holding_minutes, result, day (of entry, numbered), symbol.
    """
    e = table(spark, sf_dir, "events")
    return _ledger(e, "event_id", "event_id", F.col("ts"), "value", "user_id").withColumn("symbol", F.concat(F.lit("S"), F.col("trade_id") % 5))


def with_context(t: DataFrame) -> DataFrame:
    """trades() with what was known at their signals and happened after, drawn from trade_id, as the tables hold neither."""
    k = F.col("trade_id").cast("long")
    return t.withColumns(
        {
            "regime": F.when(k % 7 == 0, "RANGE").otherwise("TREND"),
            "trend": F.when(k % 3 == 0, "BULLISH").when(k % 3 == 1, "BEARISH").otherwise("RANGE"),
            "rsi": (20 + k * 7 % 61).cast("double"),
            "macd_hist": (k % 11 - 5).cast("double"),
            "to_resistance": F.when(k % 13 != 0, k * 3 % 40 / 10.0),
            "to_support": F.when(k % 17 != 0, k * 5 % 39 / 10.0),
            "to_ema50": F.when(k % 19 != 0, k % 31 / 10.0),
            "mfe_r": k % 50 / 20.0,
            "mfe": k % 50 / 50.0,
            "later_r": k % 23 / 10.0,
        }
    )


def long_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of several years: one trade an order, as trades() has it."""
    return _ledger(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", F.col("o_orderdate"), "o_totalprice", "o_custkey")


#: DuckDB SQL of the adapters, for the SQL twins of the queries.
SQL_TICKS = "ticks AS (SELECT event_type AS symbol, ts, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch_s, event_id AS seq, value AS price, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def sql_bars(seconds: int = TRIGGER, name: str = "bars") -> str:
    return f"{name} AS (SELECT symbol, (epoch_s // {seconds}) * {seconds} AS epoch_s, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, count(*) AS tick_volume, floor(max(price) - min(price)) / 100 AS spread FROM ticks GROUP BY 1, 2)"


def _sql_ledger(name: str, source: str, key: str, start: str, value: str, user: str, more: str = "") -> str:
    return f"""{name} AS (SELECT *, entry_time + 60 * holding_minutes AS exit_time, r_h / 100.0::DOUBLE AS r, r_h AS pnl, CASE WHEN r_h > 100 THEN 'TP2' WHEN r_h > 0 THEN 'TP1' WHEN r_h < -100 THEN 'STOP_LOSS' ELSE 'EXPIRED' END AS result, entry_time // 86400 AS day FROM
 (SELECT {key} AS trade_id, CASE WHEN {key} % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, CAST(epoch(date_trunc('second', {start})) AS BIGINT) AS entry_time, {key} AS seq, CAST(7 + {key} % 4 AS INT) AS strength, CAST(round({value} * 100) AS BIGINT) % 401 - 200 AS r_h, 1 + {user} % 60 AS holding_minutes{more} FROM {source}))"""


SQL_CONTEXT = """context AS (SELECT *, CASE WHEN trade_id % 7 = 0 THEN 'RANGE' ELSE 'TREND' END AS regime, CASE trade_id % 3 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' ELSE 'RANGE' END AS trend, 20 + trade_id * 7 % 61 AS rsi, trade_id % 11 - 5 AS macd_hist,
 CASE WHEN trade_id % 13 <> 0 THEN trade_id * 3 % 40 / 10.0::DOUBLE END AS to_resistance, CASE WHEN trade_id % 17 <> 0 THEN trade_id * 5 % 39 / 10.0::DOUBLE END AS to_support, CASE WHEN trade_id % 19 <> 0 THEN trade_id % 31 / 10.0::DOUBLE END AS to_ema50,
 trade_id % 50 / 20.0::DOUBLE AS mfe_r, trade_id % 50 / 50.0::DOUBLE AS mfe, trade_id % 23 / 10.0::DOUBLE AS later_r FROM trades)"""
SQL_TRADES = _sql_ledger("trades", "events", "event_id", "ts", "value", "user_id", ", 'S' || (event_id % 5) AS symbol")
SQL_LONG = _sql_ledger("trades", "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_custkey")
