"""First passages of trades through levels of return, and sampled paths (FOR11, FOR12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.joins import interval
from tidemark.plans.rank import ranked

#: Levels in units of risk. Fixed values.
FAVOURABLE, ADVERSE = (0.5, 1.0, 1.5, 2.0), (0.25, 0.5, 0.75, 1.0, 1.5, 2.0)


def _moves() -> tuple[Column, Column]:
    """Favourable and adverse move of a bar from the entry, in units of risk."""
    long_ = F.col("direction") == "LONG"
    up, down = (F.col("high") - F.col("entry_price")) / F.col("risk"), (F.col("entry_price") - F.col("low")) / F.col("risk")
    return F.greatest(F.lit(0.0), F.when(long_, up).otherwise(down)), F.greatest(F.lit(0.0), F.when(long_, down).otherwise(up))


def first_passages(trades: DataFrame, bars: DataFrame, width: int, favourable: tuple[float, ...] = FAVOURABLE, adverse: tuple[float, ...] = ADVERSE) -> DataFrame:
    """For each trade the first time that each level is reached, fav and adv: arrays of seconds, null where it is not (FOR12).

    trades: symbol, trade_id, direction, strength, entry_time, exit_time,
    entry_price, risk, r_h. One interval join and one aggregation; later is the
    furthest favourable move from the bar after each adverse passage on. Bars
    from entry to exit count, both included.
    """
    fav, adv = _moves()
    j = interval(bars.select("symbol", "epoch_s", "high", "low"), trades, ["symbol"], "epoch_s", "entry_time", "exit_time", width).withColumns({"_f": fav, "_a": adv})
    first = lambda c, levels: F.array(*[F.min(F.when(F.col(c) >= x, F.col("epoch_s"))) for x in levels])
    keep = ["direction", "strength", "entry_time", "r_h"]
    out = j.groupBy("symbol", "trade_id").agg(*[F.first(c).alias(c) for c in keep], first("_f", favourable).alias("fav"), first("_a", adverse).alias("adv"), F.collect_list(F.struct("epoch_s", "_f")).alias("_path"), F.max("_f").alias("mfe_r"), F.max("_a").alias("mae_r"))
    later = F.transform("adv", lambda t: F.array_max(F.transform(F.filter("_path", lambda x: x["epoch_s"] > t), lambda x: x["_f"])))
    return out.withColumn("later", later).drop("_path")


def reach_by_score(passages: DataFrame, favourable: tuple[float, ...] = FAVOURABLE) -> DataFrame:
    """For each score the share of trades that reach each favourable level, in percent."""
    parts = F.array(*[F.struct(F.lit(x).alias("level"), F.count(F.col("fav")[i]).alias("reached")) for i, x in enumerate(favourable)])
    g = passages.groupBy("strength").agg(F.count(F.lit(1)).alias("trades"), parts.alias("x"))
    return g.select("strength", "trades", F.explode("x").alias("x")).select("strength", "trades", "x.*").withColumn("share", F.round(F.col("reached") * 100 / F.col("trades"), 6))


def recovery(passages: DataFrame, adverse: tuple[float, ...] = ADVERSE) -> DataFrame:
    """For each adverse level how many trades reach it, how long it takes on average, and how many later gain 1 and 2 units."""
    later = lambda i, r: F.count_if(F.coalesce(F.col("later")[i] >= r, F.lit(False)))
    parts = F.array(*[F.struct(F.lit(x).alias("level"), F.count(F.lit(1)).alias("trades"), F.count(F.col("adv")[i]).alias("reached"), F.round(F.avg((F.col("adv")[i] - F.col("entry_time")) / 60), 6).alias("minutes"), later(i, 1).alias("later_1r"), later(i, 2).alias("later_2r")) for i, x in enumerate(adverse)])
    return passages.agg(parts.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def time_to_adverse(passages: DataFrame, level: int = 1) -> DataFrame:
    """Trades by the minutes until they stand at an adverse level (by its place in the array): how many, how many lost, and mean excursions."""
    m = (F.col("adv")[level] - F.col("entry_time")) / 60
    bucket = F.when(m.isNull(), "never").when(m <= 60, "0-60").when(m <= 180, "60-180").when(m <= 360, "180-360").when(m <= 720, "360-720").otherwise("720+")
    return passages.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("r_h") < 0).alias("lost"), F.round(F.avg("mfe_r"), 6).alias("mfe_r"), F.round(F.avg("mae_r"), 6).alias("mae_r"))


def sampled(trades: DataFrame, order: list[Column], count: int = 20) -> DataFrame:
    """Every k-th trade of an order, count of them, k the whole part of their number by count (FOR11); with place, from 0."""
    rows = ranked(trades, order, "place").withColumn("place", F.col("place") - 1)
    n = rows.count()
    step = max(1, n // count)
    return rows.where((F.col("place") % step == 0) & (F.col("place") < min(n, count * step)))


def paths(trades: DataFrame, bars: DataFrame, width: int) -> DataFrame:
    """The path of each trade: entry, farthest adverse, farthest favourable, exit, with the minute it is there and the return (FOR11).

    The extremes are where they are first reached.
    """
    fav, adv = _moves()
    j = interval(bars.select("symbol", "epoch_s", "high", "low"), trades, ["symbol"], "epoch_s", "entry_time", "exit_time", width).withColumns({"_f": fav, "_a": adv})
    top = lambda c: F.max(F.struct(F.col(c).alias("r"), (-F.col("epoch_s")).alias("t")))
    g = j.groupBy("symbol", "trade_id").agg(F.first("entry_time").alias("entry_time"), F.first("exit_time").alias("exit_time"), F.first("r_h").alias("r_h"), top("_f").alias("f"), top("_a").alias("a"))
    minute = lambda t: ((t - F.col("entry_time")) / 60).cast("double")
    step = lambda name, m, r: F.struct(F.lit(name).alias("step"), m.alias("minute"), F.round(r, 6).alias("r"))
    points = F.array(step("entry", F.lit(0.0), F.lit(0.0)), step("adverse", minute(-F.col("a.t")), -F.col("a.r")), step("favourable", minute(-F.col("f.t")), F.col("f.r")), step("exit", minute(F.col("exit_time")), F.col("r_h") / 100.0))
    return g.select("symbol", "trade_id", F.explode(points).alias("x")).select("symbol", "trade_id", "x.*")
