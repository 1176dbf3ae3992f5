"""Walk-forward windows and their evaluation (VAL1-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.plans.joins import interval

DAY = 86400


def slices(start: int, end: int, train: int = 90, val: int = 30, step: int = 30) -> list[tuple[int, int, int, int, int]]:
    """Sliding windows (index, train start and end, validation start and end) over start..end, lengths in days (VAL1).

    A history too short for one window is split 70 to 30 if it has an hour and
    the test part half an hour. The last window may be short: at least a day and
    half the validation length.
    """
    out, t = [], start
    while t + train * DAY < end:
        split = t + train * DAY
        stop = min(split + val * DAY, end)
        if stop - split < (val * DAY if stop == split + val * DAY else max(DAY, val * DAY // 2)):
            break
        out.append((len(out) + 1, t, split, split, stop))
        if stop == end:
            break
        t += step * DAY
    if not out and end - start >= 3600:
        split = start + (end - start) * 7 // 10
        if end - split >= 1800:
            out.append((1, start, split, split, end))
    return out


def frame(spark: SparkSession, windows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(windows, "window_index int, train_start long, train_end long, val_start long, val_end long")


def within(trades: DataFrame, windows: DataFrame, closed: str = "left") -> DataFrame:
    """Trades with each window whose validation part they were entered in (VAL3).

    closed "left" gives a boundary trade to the later window, "both" to both.
    An equi-join on slots of a month, which windows are repeated for.
    """
    return interval(trades, windows, [], "entry_time", "val_start", "val_end", 30 * DAY, closed == "both")


def evaluate(trades: DataFrame, windows: DataFrame, closed: str = "left") -> DataFrame:
    """Each window's figures with its own drawdown."""
    keys = ["window_index", "val_start", "val_end"]
    t = within(trades, windows, closed)
    g = stats.by_group(t, F.struct(*keys), "w").select(*[F.col(f"w.{k}").alias(k) for k in keys], "trades", "wins", "win_rate", "total_r", "average_r", "profit_factor")
    return g.join(stats.drawdown(t, ["window_index"]).select("window_index", "max_drawdown"), "window_index")


def with_warmup(bars: DataFrame, start: int, end: int, bars_before: int) -> DataFrame:
    """Bars from some before start to end, both included (VAL2)."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy(F.desc("epoch_s"))
    early = bars.where(F.col("epoch_s") < start).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= bars_before).drop("_n")
    return early.unionByName(bars.where((F.col("epoch_s") >= start) & (F.col("epoch_s") <= end)))
