"""Labels of time, volatility and price action (CLS)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.scan import last_known
from tidemark.plans.slices import halo, own


def _hour(epoch_s: str) -> Column:
    return F.hour(F.timestamp_seconds(epoch_s))


def session(epoch_s: str) -> Column:
    """Five sessions of the UTC day, from 0, 8, 13, 16 and 21 hours (CLS1)."""
    h = _hour(epoch_s)
    return F.when(h < 8, "Asia").when(h < 13, "London").when(h < 16, "London/NY Overlap").when(h < 21, "New York").otherwise("Off-Session")


def session_detail(epoch_s: str) -> dict[str, Column]:
    """Other sessions, from 0, 7, 13, 17 and 21 hours, with two-hour block, hour and weekday (CLS2)."""
    h = _hour(epoch_s)
    span = lambda a, b: F.format_string("%02d:00-%02d:00 UTC", a, b)
    low = (h - h % 2).cast("int")
    name = F.when(h < 7, "ASIAN").when(h < 13, "LONDON").when(h < 17, "NY_OVERLAP").when(h < 21, "NY_AFTERNOON").otherwise("LATE_NIGHT")
    return {"session": name, "block": span(low, low + 2), "hour_label": span(h, h + 1), "weekday": F.date_format(F.timestamp_seconds(epoch_s), "EEEE")}


def filled(rows: DataFrame, value: str, order: str = "epoch_s", by: str = "symbol", default: float = 1.5) -> DataFrame:
    """rows with the last known value, default before the first (CLS4)."""
    known = last_known(rows.withColumn("_day", F.floor(F.col(order) / 86400)), [by], "_day", [order], value, "_known")
    return known.withColumn(value, F.coalesce("_known", F.lit(default))).drop("_known", "_day")


def volatility_quintile(value: str, window: Column) -> Column:
    """Fifth of the trailing values (an array) that a value falls in, fixed bounds with fewer than five (CLS3)."""
    v = F.col(value)
    n = F.size(window)
    rank = F.size(F.filter(window, lambda a: a <= v)) / n
    few = F.when(v < 1.0, "Q1").when(v < 1.5, "Q2").when(v < 2.0, "Q3").when(v < 2.8, "Q4").otherwise("Q5")
    return F.when(n < 5, few).when(rank <= 0.2, "Q1").when(rank <= 0.4, "Q2").when(rank <= 0.6, "Q3").when(rank <= 0.8, "Q4").otherwise("Q5")


def with_volatility(bars: DataFrame, value: str, n: int = 121, by: str = "symbol", order: str = "epoch_s") -> DataFrame:
    """bars with quintile, the fifth of the last n values, this one included, that a value falls in (CLS3)."""
    rows, keys = halo(bars, [by], [order], n - 1)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
    seen = rows.withColumn("_seen", F.collect_list(value).over(w))
    return own(seen.withColumn("quintile", volatility_quintile(value, F.col("_seen"))).drop("_seen"))


def candle_features(atr: str = "atr") -> dict[str, Column]:
    """Body, range (at least 0.01), their ratio, and distance from the averages in ATR of at least 0.1 (CLS7)."""
    body, width = F.abs(F.col("close") - F.col("open")), F.greatest(F.lit(0.01), F.col("high") - F.col("low"))
    unit = F.greatest(F.lit(0.1), F.col(atr))
    return {"body": body, "range": width, "body_ratio": body / width, "displacement21": (F.col("close") - F.col("ema21")) / unit, "displacement50": (F.col("close") - F.col("ema50")) / unit}


def with_impulse(bars: DataFrame, direction: str, atr: str = "atr", by: str = "symbol", order: str = "epoch_s") -> DataFrame:
    """bars with state, how far a move has come at a bar's close (CLS5): NEUTRAL in the first five bars, then LATE, PULLBACK, EARLY, in this order."""
    rows, keys = halo(bars, [by], [order], 2)
    w = Window.partitionBy(*keys).orderBy(order)
    sign = F.when(F.col(direction) == "LONG", 1).otherwise(-1)
    unit = F.greatest(F.lit(0.1), F.col(atr))
    d21, d50 = sign * (F.col("close") - F.col("ema21")) / unit, sign * (F.col("close") - F.col("ema50")) / unit
    o1, o2, c1, c2 = (F.lag(c, k).over(w) for c, k in (("open", 1), ("open", 2), ("close", 1), ("close", 2)))
    move2, move3 = F.abs(F.col("close") - o1) / unit, F.abs(F.col("close") - o2) / unit
    along = sum(((sign * (c - o)) > 0).cast("int") for c, o in ((F.col("close"), F.col("open")), (c1, o1), (c2, o2)))
    late = (d21 > 0.9) | (move3 > 1.8) | ((along == 3) & (d21 > 0.7))
    state = F.when(F.col("_pos") < 5, "NEUTRAL").when(late, "LATE_IMPULSE").when((d21 <= 0.35) & (d50 >= 0), "CONTROLLED_PULLBACK").when((d21 >= 0.2) & (d21 <= 0.7) & (move2 <= 1) & (along <= 2), "EARLY_IMPULSE").otherwise("NEUTRAL")
    return own(rows.withColumn("state", state))


def regime(trend: str, structure: str, distance: str) -> Column:
    """Expansion beyond two ATR from the slow average, then strong trend, pullback, range (CLS6)."""
    up = F.col(trend).isin("BULLISH", "BEARISH")
    return F.when(F.col(distance) > 2, "VOLATILITY_EXPANSION").when(up & (F.col(structure) == F.col(trend)), "STRONG_TREND").when(up, "TREND_PULLBACK").otherwise("RANGE_COMPRESSION")
