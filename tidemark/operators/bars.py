"""Ticks to bars, and what is done with bars as they come (AGG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.scan import running_max
from tidemark.plans.slices import halo, own

#: Numbers of arrival of one bucket of a scan.
ARRIVALS = 10_000


def bucket(epoch_s: Column | str, seconds: int) -> Column:
    """Start of the tumbling bucket of some length."""
    c = F.col(epoch_s) if isinstance(epoch_s, str) else epoch_s
    return c - F.pmod(c, F.lit(seconds))


def aggregate(ticks: DataFrame, seconds: int) -> DataFrame:
    """One bar for each symbol and bucket that has a tick (AGG1, AGG2, AGG4).

    Open and close are the first and last price by order of arrival (seq), so a
    late tick overwrites the close of its bucket. Empty buckets give no bar. The
    aggregation is partial before its only shuffle.
    """
    return ticks.groupBy("symbol", bucket("epoch_s", seconds).alias("epoch_s")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.count(F.lit(1)).alias("tick_volume"),
    )


def aggregate_by_event_time(ticks: DataFrame, seconds: int) -> DataFrame:
    """As aggregate(), open and close by event time instead of arrival."""
    at = F.struct("ts", "seq")
    return ticks.groupBy("symbol", bucket("epoch_s", seconds).alias("epoch_s")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("tick_volume"))


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """Longer bars from shorter ones by time buckets (AGG5)."""
    return bars.groupBy("symbol", bucket("epoch_s", seconds).alias("epoch_s")).agg(
        F.min_by("open", bars["epoch_s"]).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", bars["epoch_s"]).alias("close"), F.sum("tick_volume").alias("tick_volume")
    )


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The latest n bars of each symbol, as a live buffer keeps them (AGG3); a rank limit is pushed below the shuffle."""
    w = Window.partitionBy("symbol").orderBy(F.desc("epoch_s"))
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def after_eviction(ticks: DataFrame, seconds: int, keep: int) -> DataFrame:
    """The ticks that still find their bar (AGG2): those not older than the last keep buckets at their arrival.

    A tick is late beyond eviction if its bucket is keep buckets or more behind
    the latest bucket that arrived before it. Gaps make the live buffer reach
    further back; this bound is by time, as a watermark's.
    """
    t = ticks.withColumns({"_of": bucket("epoch_s", seconds), "_part": F.floor(F.col("seq") / ARRIVALS)})
    top = running_max(t, ["symbol"], "_part", ["seq"], "_of", "_top", F.lit(-(1 << 62)))
    return top.where(F.col("_of") > F.col("_top") - keep * seconds).drop("_of", "_part", "_top")


def changes(bars: DataFrame) -> DataFrame:
    """Bars whose prices differ from those of the bar before (AGG6)."""
    rows, keys = halo(bars, ["symbol"], ["epoch_s"], 1)
    w = Window.partitionBy(*keys).orderBy("epoch_s")
    now = F.struct("open", "high", "low", "close")
    return own(rows.withColumn("_was", F.lag(now).over(w))).where(F.col("_was").isNull() | (F.col("_was") != now)).drop("_was")


def stale(ticks: DataFrame, now: Column, seconds: int) -> DataFrame:
    """For each symbol the last tick's time and whether it is older than some seconds (AGG7)."""
    return ticks.groupBy("symbol").agg(F.max("epoch_s").alias("last_s")).withColumn("stale", now - F.col("last_s") > seconds)
