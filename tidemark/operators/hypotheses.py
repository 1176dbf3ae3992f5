"""Predicates over annotated signals, stated as data and judged together in one pass (EXP6, user predicates)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import classify
from tidemark.plans.slices import halo, own


@dataclass(frozen=True)
class Hypothesis:
    """A named condition on the columns of annotated(): SQL text, a Column, or a function of a batch that gives booleans."""

    id: str
    title: str
    keep: str | Column | Callable[[pd.DataFrame], pd.Series]


_ALIGNED = "(close > open AND direction = 'LONG' OR close < open AND direction = 'SHORT')"
_LIVELY = "quintile IN ('Q3', 'Q4', 'Q5')"

#: Research hypotheses (EXP6). Ids, thresholds and the states they name are fixed values.
HYPOTHESES = (
    Hypothesis("V2-H001", "close at most 0.6 ATR beyond the average", "distance21 <= 0.60"),
    Hypothesis("V2-H002", "opposing level at least 1 ATR away", "clearance >= 1.0"),
    Hypothesis("V2-H003", "body of at least half the range, closed its way", f"{_ALIGNED} AND body_ratio >= 0.50"),
    Hypothesis("V2-H004", "the bar before was the same setup", "previous_type = type AND previous_strength >= 7"),
    Hypothesis("V2-H005", "volatile, and the trend has a direction", "unit >= 1.50 AND trend IN ('BULLISH', 'BEARISH')"),
    Hypothesis("V2-H006", "pull-back, clearance, body and volatility", f"distance21 <= 0.75 AND clearance >= 0.75 AND {_ALIGNED} AND unit >= 1.00"),
    Hypothesis("V6E-H001", "controlled pull-back in high volatility", "state = 'CONTROLLED_PULLBACK' AND quintile IN ('Q4', 'Q5')"),
    Hypothesis("V6E-H002", "early impulse, clear of levels", "state = 'EARLY_IMPULSE' AND clearance >= 1.0"),
    Hypothesis("V6E-H003", "London and New York in volatile hours", f"session_block IN ('LONDON', 'NY_OVERLAP') AND {_LIVELY}"),
    Hypothesis("V6E-H004", "no late impulse", "state <> 'LATE_IMPULSE'"),
    Hypothesis("V6E-H005", "strong trend and a high score", "regime = 'STRONG_TREND' AND strength >= 8"),
    Hypothesis("V6E-H006", "impulse or pull-back, clear, volatile", f"state IN ('EARLY_IMPULSE', 'CONTROLLED_PULLBACK') AND clearance >= 0.8 AND {_LIVELY}"),
)


def annotated(scored: DataFrame, by: str = "symbol", order: str = "epoch_s") -> DataFrame:
    """Scored bars with what the hypotheses look at: one row a bar, those without a setup among them.

    scored: type, strength, trend, structure, open, high, low, close, atr, ema21,
    ema50, supports and resistances (arrays of structs with price, the nearest
    first). Adds direction, unit (ATR of at least 0.1, 1.5 if unknown),
    distance21, clearance (999 without an opposing level), body_ratio, the type
    and strength of the bar before, impulse state, volatility quintile, session
    block and regime.
    """
    long_ = F.col("type") == "LONG_SETUP"
    sign = F.when(long_, 1).otherwise(-1)
    unit = F.greatest(F.lit(0.1), F.coalesce("atr", F.lit(1.5)))
    level = F.when(long_, F.try_element_at("resistances", F.lit(1))["price"] - F.col("close")).otherwise(F.col("close") - F.try_element_at("supports", F.lit(1))["price"])
    a = scored.withColumns({"direction": F.when(long_, "LONG").otherwise("SHORT"), "unit": unit, "body_ratio": F.abs(F.col("close") - F.col("open")) / F.greatest(F.lit(0.01), F.col("high") - F.col("low")), "session_block": classify.session_detail(order)["session"]})
    a = a.withColumn("_far", F.abs(F.col("close") - F.col("ema50")) / F.col("unit"))
    a = a.withColumns({"distance21": sign * (F.col("close") - F.coalesce("ema21", "close")) / F.col("unit"), "clearance": F.coalesce(level / F.col("unit"), F.lit(999.0)), "regime": classify.regime("trend", "structure", "_far")})
    rows, keys = halo(a.drop("_far"), [by], [order], 1)
    w = Window.partitionBy(*keys).orderBy(order)
    a = own(rows.withColumns({"previous_type": F.lag("type").over(w), "previous_strength": F.lag("strength").over(w)}))
    return classify.with_volatility(classify.with_impulse(a, "direction", "unit", by, order), "unit", by=by, order=order)


def _compiled(h: Hypothesis) -> Column:
    return F.coalesce(F.expr(h.keep) if isinstance(h.keep, str) else h.keep, F.lit(False))


def judged(rows: DataFrame, hypotheses: tuple[Hypothesis, ...] = HYPOTHESES) -> DataFrame:
    """rows with kept, an array of a boolean for each hypothesis; what is unknown keeps nothing.

    SQL texts and Columns are evaluated where the rows are scanned; functions
    are given Arrow batches of all columns, once for all of them together.
    """
    foreign = [h for h in hypotheses if callable(h.keep) and not isinstance(h.keep, Column)]
    if foreign:
        names = rows.columns

        @F.pandas_udf("array<boolean>")
        def ask(batch: pd.DataFrame) -> pd.Series:
            answers = [h.keep(batch).fillna(False).astype(bool) for h in foreign]
            return pd.Series(list(map(list, zip(*answers, strict=True))), index=batch.index)

        rows = rows.withColumn("_asked", ask(F.struct(*names)))
    at = {h.id: i for i, h in enumerate(foreign)}
    bits = F.array(*[F.col("_asked")[at[h.id]] if h.id in at else _compiled(h) for h in hypotheses])
    return rows.withColumn("kept", bits).drop("_asked")


def tagged(rows: DataFrame, hypotheses: tuple[Hypothesis, ...] = HYPOTHESES) -> DataFrame:
    """judged() setups, a row for each hypothesis that keeps them, with only, the hypothesis' id: what a replay of all together takes."""
    ids = F.array(*[F.lit(h.id) for h in hypotheses])
    kept = F.transform(F.filter(F.arrays_zip("kept", ids.alias("id")), lambda x: x["kept"]), lambda x: x["id"])
    return judged(rows.where("type <> 'WAIT'"), hypotheses).withColumn("only", F.explode(kept)).drop("kept")


def summary(rows: DataFrame, value: str, hypotheses: tuple[Hypothesis, ...] = HYPOTHESES) -> DataFrame:
    """For each hypothesis how many setups there are and it keeps, and the total of a whole-number value of those; one pass, one aggregation."""
    j = judged(rows.where("type <> 'WAIT'"), hypotheses)
    parts = [F.struct(F.lit(h.id).alias("hypothesis"), F.count(F.lit(1)).alias("setups"), F.count_if(F.col("kept")[i]).alias("kept"), F.coalesce(F.sum(F.when(F.col("kept")[i], F.col(value))), F.lit(0)).alias("total")) for i, h in enumerate(hypotheses)]
    return j.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
