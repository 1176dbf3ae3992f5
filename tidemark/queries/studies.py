"""Studies of passages, sampled paths and hypotheses over positions and setups made from the bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import hypotheses, passages
from tidemark.queries.market import _B, H
from tidemark.queries.strategy import _ATR, _EMA, _WILDER, _WINS
from tidemark.sources import adapters as A

#: Risk of a position, and bars of its longest holding.
RISK, LONGEST = 40.0, 24


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar as a position entered at its open and held for 1 to 24 hours; r_h is its return after the first bar."""
    k = F.floor(F.col("epoch_s") / H)
    sign = F.when(k % 2 == 0, 1).otherwise(-1)
    return A.bars(spark, sf_dir).select(
        "symbol", F.concat_ws("|", "symbol", "epoch_s").alias("trade_id"), F.when(k % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), F.least(F.lit(10), 6 + F.col("tick_volume")).cast("int").alias("strength"),
        F.col("epoch_s").alias("entry_time"), (F.col("epoch_s") + H * (1 + k % LONGEST)).alias("exit_time"), F.col("open").alias("entry_price"), F.lit(RISK).alias("risk"), F.round(sign * (F.col("close") - F.col("open")) / RISK * 100).cast("long").alias("r_h"),
    )


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.first_passages(positions(spark, sf_dir), A.bars(spark, sf_dir), LONGEST * H)


def for12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _passages(spark, sf_dir)
    return p.select("symbol", "trade_id", *[F.col("fav")[i].alias(f"fav{i}") for i in range(4)], *[F.col("adv")[i].alias(f"adv{i}") for i in range(6)])


def for12_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.reach_by_score(_passages(spark, sf_dir))


def for12_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.recovery(_passages(spark, sf_dir))


def for12_time_to_adverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.time_to_adverse(_passages(spark, sf_dir))


def for11_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty positions, taken evenly over time, and how each went."""
    t = passages.sampled(positions(spark, sf_dir), [F.asc("entry_time"), F.asc("symbol")], 20)
    return passages.paths(t, A.bars(spark, sf_dir), LONGEST * H)


def setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar whose averages are known as a setup, long and short in turns of three bars; levels are the extremes of the 120 bars before."""
    w = F.col("win")
    before = F.slice(w, F.lit(1), F.size(w) - 1)
    c = F.transform(w, lambda b: b["close"])
    b = I.sliding(A.bars(spark, sf_dir), I.TRIGGER_SLICE).withColumns({"ema21": I.ema(c, 21), "ema50": I.ema(c, 50), "atr": I.atr(w), "_top": F.array_max(F.transform(before, lambda x: x["high"])), "_low": F.array_min(F.transform(before, lambda x: x["low"]))}).drop("win")
    level = lambda ok, p: F.when(ok, F.array(F.struct(F.col(p).alias("price")))).otherwise(F.array().cast("array<struct<price:double>>"))
    up = F.floor(F.col("epoch_s") / (3 * H)) % 2 == 0
    return b.withColumns(
        {
            "type": F.when(F.col("ema50").isNull(), "WAIT").when(up, "LONG_SETUP").otherwise("SHORT_SETUP"),
            "trend": F.when(F.col("ema21") > F.col("ema50"), "BULLISH").otherwise("BEARISH"),
            "structure": F.when(F.col("close") > F.col("ema50"), "BULLISH").otherwise("BEARISH"),
            "strength": 6 + sum(F.coalesce(x, F.lit(False)).cast("int") for x in (F.col("close") > F.col("ema21"), F.col("ema21") > F.col("ema50"), F.col("close") > F.col("open"))),
            "resistances": level(F.col("_top") > F.col("close"), "_top"),
            "supports": level(F.col("_low") < F.col("close"), "_low"),
        }
    ).drop("_top", "_low")


def exp6_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve hypotheses over all setups, with the tick volume of the bars that they keep."""
    return hypotheses.summary(hypotheses.annotated(setups(spark, sf_dir)), "tick_volume")


QUERIES = {f.__name__: f for f in (for11_paths, for12_passages, for12_reach, for12_recovery, for12_time_to_adverse, exp6_hypotheses)}

_SQL_MOVES = f"""{_B}, pos AS (SELECT symbol, symbol || '|' || epoch_s AS trade_id, (epoch_s // {H}) % 2 = 0 AS long_, least(10, 6 + tick_volume) AS strength, epoch_s AS entry_time, epoch_s + {H} * (1 + (epoch_s // {H}) % {LONGEST}) AS exit_time, open AS entry_price,
 CAST(round(CASE WHEN (epoch_s // {H}) % 2 = 0 THEN close - open ELSE open - close END / {RISK} * 100) AS BIGINT) AS r_h FROM bars),
 j AS (SELECT p.*, b.epoch_s, greatest(0, CASE WHEN long_ THEN b.high - entry_price ELSE entry_price - b.low END / {RISK}) AS f, greatest(0, CASE WHEN long_ THEN entry_price - b.low ELSE b.high - entry_price END / {RISK}) AS a FROM pos p JOIN bars b ON b.symbol = p.symbol AND b.epoch_s BETWEEN p.entry_time AND p.exit_time),
 t AS (SELECT symbol, trade_id, any_value(strength) AS strength, any_value(entry_time) AS entry_time, any_value(r_h) AS r_h, max(f) AS mfe_r, max(a) AS mae_r, {', '.join(f'min(epoch_s) FILTER (f >= {x}) AS fav{i}' for i, x in enumerate(passages.FAVOURABLE))}, {', '.join(f'min(epoch_s) FILTER (a >= {x}) AS adv{i}' for i, x in enumerate(passages.ADVERSE))} FROM j GROUP BY 1, 2)"""
_LATER = lambda i: f"SELECT t.*, (SELECT max(f) FROM j WHERE j.symbol = t.symbol AND j.trade_id = t.trade_id AND j.epoch_s > t.adv{i}) AS later FROM t"
_SQL_SETUPS = f"""{_WINS}, {_ATR}, base AS (SELECT symbol, epoch_s, {_EMA(21)} AS ema21, {_EMA(50)} AS ema50, greatest(0.1, coalesce(CASE WHEN n > 14 THEN round({_WILDER("t")}, 4) END, 1.5)) AS unit FROM tr),
 y AS (SELECT *, CASE WHEN (epoch_s // {3 * H}) % 2 = 0 THEN 1 ELSE -1 END AS g, row_number() OVER w AS k, {', '.join(f'lag({c}, {j}) OVER w AS {c[0]}{j}' for c in ('open', 'close') for j in (1, 2))}, max(high) OVER v AS hi, min(low) OVER v AS lo,
 CASE WHEN ema50 IS NULL THEN 'WAIT' WHEN (epoch_s // {3 * H}) % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS type, 6 + coalesce(CAST(close > ema21 AS INT), 0) + coalesce(CAST(ema21 > ema50 AS INT), 0) + CAST(close > open AS INT) AS strength, list(unit) OVER (PARTITION BY symbol ORDER BY epoch_s ROWS 120 PRECEDING) AS units
 FROM bars JOIN base USING (symbol, epoch_s) WINDOW w AS (PARTITION BY symbol ORDER BY epoch_s), v AS (PARTITION BY symbol ORDER BY epoch_s ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)),
 z AS (SELECT *, lag(type) OVER w AS ptype, lag(strength) OVER w AS pstrength, g * (close - ema21) / unit AS d21, g * (close - ema50) / unit AS d50, abs(close - o1) / unit AS move2, abs(close - o2) / unit AS move3, CAST(g * (close - open) > 0 AS INT) + CAST(g * (c1 - o1) > 0 AS INT) + CAST(g * (c2 - o2) > 0 AS INT) AS along,
 coalesce(CASE WHEN g > 0 THEN CASE WHEN hi > close THEN hi - close END ELSE CASE WHEN lo < close THEN close - lo END END / unit, 999) AS clearance, len(list_filter(units, lambda x: x <= unit)) / len(units) AS rank, hour(make_timestamp(epoch_s * 1000000)) AS hr FROM y WINDOW w AS (PARTITION BY symbol ORDER BY epoch_s)),
 s AS (SELECT *, CASE WHEN k <= 5 THEN 'NEUTRAL' WHEN d21 > 0.9 OR move3 > 1.8 OR (along = 3 AND d21 > 0.7) THEN 'LATE' WHEN d21 <= 0.35 AND d50 >= 0 THEN 'PULLBACK' WHEN d21 >= 0.2 AND d21 <= 0.7 AND move2 <= 1 AND along <= 2 THEN 'EARLY' ELSE 'NEUTRAL' END AS state,
 CASE WHEN rank <= 0.2 THEN 1 WHEN rank <= 0.4 THEN 2 WHEN rank <= 0.6 THEN 3 WHEN rank <= 0.8 THEN 4 ELSE 5 END AS q, g * (close - open) > 0 AS aligned, abs(close - open) / greatest(0.01, high - low) AS body FROM z WHERE type <> 'WAIT')"""
#: The hypotheses as they are meant, written anew over the names above.
_SQL_KEEP = {
    "V2-H001": "d21 <= 0.6", "V2-H002": "clearance >= 1", "V2-H003": "aligned AND body >= 0.5", "V2-H004": "ptype = type AND pstrength >= 7", "V2-H005": "unit >= 1.5", "V2-H006": "d21 <= 0.75 AND clearance >= 0.75 AND aligned AND unit >= 1",
    "V6E-H001": "state = 'PULLBACK' AND q >= 4", "V6E-H002": "state = 'EARLY' AND clearance >= 1", "V6E-H003": "hr >= 7 AND hr < 17 AND q >= 3", "V6E-H004": "state <> 'LATE'",
    "V6E-H005": "abs(close - ema50) / unit <= 2 AND (ema21 > ema50) = (close > ema50) AND strength >= 8", "V6E-H006": "state IN ('EARLY', 'PULLBACK') AND clearance >= 0.8 AND q >= 3",
}

ORACLES = {
    "for12_passages": f"{_SQL_MOVES} SELECT symbol, trade_id, {', '.join(f'fav{i}' for i in range(4))}, {', '.join(f'adv{i}' for i in range(6))} FROM t",
    "for12_reach": f"{_SQL_MOVES} " + " UNION ALL ".join(f"SELECT strength, count(*) AS trades, {x}::DOUBLE AS level, count(fav{i}) AS reached, round(count(fav{i}) * 100 / count(*), 6) AS share FROM t GROUP BY 1" for i, x in enumerate(passages.FAVOURABLE)),
    "for12_recovery": f"{_SQL_MOVES} " + " UNION ALL ".join(f"SELECT {x}::DOUBLE AS level, count(*) AS trades, count(adv{i}) AS reached, round(avg((adv{i} - entry_time) / 60), 6) AS minutes, count(*) FILTER (later >= 1) AS later_1r, count(*) FILTER (later >= 2) AS later_2r FROM ({_LATER(i)})" for i, x in enumerate(passages.ADVERSE)),
    "for12_time_to_adverse": f"{_SQL_MOVES} SELECT CASE WHEN adv1 IS NULL THEN 'never' WHEN m <= 60 THEN '0-60' WHEN m <= 180 THEN '60-180' WHEN m <= 360 THEN '180-360' WHEN m <= 720 THEN '360-720' ELSE '720+' END AS bucket, count(*) AS trades, count(*) FILTER (r_h < 0) AS lost, round(avg(mfe_r), 6) AS mfe_r, round(avg(mae_r), 6) AS mae_r FROM (SELECT *, (adv1 - entry_time) / 60 AS m FROM t) GROUP BY 1",
    "for11_paths": f"""{_SQL_MOVES}, n AS (SELECT *, row_number() OVER (ORDER BY entry_time, symbol) - 1 AS place, count(*) OVER () AS n FROM pos), c AS (SELECT symbol, trade_id FROM n WHERE place % greatest(1, n // 20) = 0 AND place < least(n, 20 * greatest(1, n // 20))),
 e AS (SELECT symbol, trade_id, any_value(entry_time) AS entry_time, any_value(exit_time) AS exit_time, any_value(r_h) AS r_h, max(f) AS f, max(a) AS a, arg_max(epoch_s, (f, -epoch_s)) AS t_f, arg_max(epoch_s, (a, -epoch_s)) AS t_a FROM j JOIN c USING (symbol, trade_id) GROUP BY 1, 2)
 SELECT symbol, trade_id, 'entry' AS step, 0.0::DOUBLE AS minute, 0.0::DOUBLE AS r FROM e UNION ALL SELECT symbol, trade_id, 'adverse', (t_a - entry_time) / 60, round(-a, 6) FROM e UNION ALL SELECT symbol, trade_id, 'favourable', (t_f - entry_time) / 60, round(f, 6) FROM e UNION ALL SELECT symbol, trade_id, 'exit', (exit_time - entry_time) / 60, round(r_h / 100, 6) FROM e""",
    "exp6_hypotheses": f"{_SQL_SETUPS} " + " UNION ALL ".join(f"SELECT '{h}' AS hypothesis, count(*) AS setups, count(*) FILTER ({c}) AS kept, CAST(coalesce(sum(tick_volume) FILTER ({c}), 0) AS BIGINT) AS total FROM s" for h, c in _SQL_KEEP.items()),
}
