"""Bars from a stream of ticks (STR1-3, AGG2, AGG6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, length: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Bars of (symbol, ts, seq, price) ticks; a tick later than the watermark is dropped.

    Open and close go by order of arrival, so a late tick within the watermark
    overwrites the close. In update mode a bar is given out whenever it changes,
    in append mode once its bucket has closed.
    """
    t = ticks.withWatermark("ts", late)
    g = t.groupBy("symbol", F.window("ts", length).alias("w"))
    out = g.agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.count(F.lit(1)).alias("tick_volume"))
    return out.select("symbol", F.unix_timestamp("w.start").alias("epoch_s"), "open", "high", "low", "close", "tick_volume")


def health(ticks: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """Whether each symbol's feed is ACTIVE, by its last tick (STR9)."""
    last = ticks.groupBy("symbol").agg(F.max("ts").alias("last"))
    return last.select("symbol", "last", F.when(F.unix_timestamp(now) - F.unix_timestamp("last") < seconds, "ACTIVE").otherwise("STALE").alias("feed"))


def changed(previous: dict, price: float, now: float, new_bar: bool, wait: float = 1.5, step: float = 0.10) -> bool:
    """Whether a tick calls for a new analysis (STR4): the first, a new bar, or enough time and movement since the last."""
    return not previous or new_bar or (now - previous["at"] >= wait and abs(price - previous["price"]) >= step)
