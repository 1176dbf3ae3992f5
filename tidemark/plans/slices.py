"""Windows of a bounded number of rows over histories that are longer than a task should hold.

A window over a whole history puts a key in one task. Where a row needs no more
than some rows before and after it, by position, a history is cut into slices of
consecutive rows; each slice is lent the rows around it, windows run within
slices, and only a slice's own rows are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.scan import _joined

#: Length in seconds of the buckets in which rows are first numbered, where they are ordered by time.
DAY = 86400
#: Rows of a slice at least.
LEAST = 128


def positions(df: DataFrame, by: list[str], order: list[str], width: int = DAY, name: str = "_pos") -> DataFrame:
    """df with each row's place, from 0, in its key's order.

    Rows are numbered within buckets of the first order column (a whole number),
    and what the buckets before hold is added: one row a bucket is scanned.
    Order must be total for places to be certain.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(order[0]) / width))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    numbered = rows.withColumn(name, F.row_number().over(within) - 1)
    return _joined(numbered, offsets, by, "_bucket", ["_before"]).withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_before")


def halo(df: DataFrame, by: list[str], order: list[str], before: int, after: int = 0, width: int = DAY) -> tuple[DataFrame, list[str]]:
    """df with its rows in slices, each with the rows that lie up to before ahead of it and after behind it.

    Returns the rows, with _pos (place in the key's order, from 0) and _own
    (false for a lent row), and the columns by which windows are to be
    partitioned. A slice is at least twice as long as what it is lent, so half
    more rows are dealt at most. Rows are dealt to a stated number of tasks: what
    is computed over a slice may take long though its rows are few, so tasks are
    not merged by their bytes. own() ends it.
    """
    size = max(LEAST, 2 * (before + after))
    p = F.col("_pos")
    slot = F.floor(p / size)
    low, high = F.greatest(F.floor((p - after) / size), F.lit(0)), F.floor((p + before) / size)
    rows = positions(df, by, order, width).withColumn("_slice", F.explode(F.sequence(low, high))).withColumn("_own", F.col("_slice") == slot)
    keys = [*by, "_slice"]
    return rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys), keys


def own(rows: DataFrame) -> DataFrame:
    """The rows of halo() that are a slice's own, without its columns."""
    return rows.where("_own").drop("_pos", "_slice", "_own")
