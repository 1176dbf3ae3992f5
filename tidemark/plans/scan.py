"""Running sums and maxima over long ordered rows, as two-level prefix scans.

A window over a whole history would put it in one task. Here rows are scanned
within buckets (a day, say), in parallel; the buckets' totals, one row each, are
scanned in turn and added. Order within a bucket must be total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(by: list[str], bucket: str) -> Column:
    on = F.col(f"_b.{bucket}").eqNullSafe(F.col(f"_a.{bucket}"))
    for c in by:
        on = on & F.col(f"_b.{c}").eqNullSafe(F.col(f"_a.{c}"))
    return on


def _joined(rows: DataFrame, totals: DataFrame, by: list[str], bucket: str, new: list[str]) -> DataFrame:
    return rows.alias("_a").join(totals.alias("_b"), _same(by, bucket), "left").select("_a.*", *[F.col(f"_b.{c}") for c in new])


def running_sums(df: DataFrame, by: list[str], bucket: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of sums: the sum over all rows up to and with this one, in order of bucket and order."""
    within = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, bucket).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select(*by, bucket, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    local = df.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    out = _joined(local, totals, by, bucket, [f"_o_{n}" for n in sums])
    return out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop(*[f"_o_{n}" for n in sums])


def running_max(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, name: str, least: Column) -> DataFrame:
    """df with name: the greatest value up to and with this row, and at least least."""
    within = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*by, bucket).agg(F.max(value).alias("_top")).select(*by, bucket, F.max("_top").over(earlier).alias("_before"))
    local = df.withColumn(name, F.max(value).over(within))
    return _joined(local, tops, by, bucket, ["_before"]).withColumn(name, F.greatest(name, "_before", least)).drop("_before")


def last_known(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with name: the last value up to and with this row that is not null; null before the first.

    The state carried over buckets is one value: the last known one of each.
    """
    within = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    ends = df.groupBy(*by, bucket).agg(latest.alias("_last")).select(*by, bucket, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    local = df.withColumn(name, F.last(value, ignorenulls=True).over(within))
    return _joined(local, ends, by, bucket, ["_carried"]).withColumn(name, F.coalesce(name, "_carried")).drop("_carried")


def runs(df: DataFrame, by: list[str], bucket: str, order: list[str], inside: Column, name: str) -> DataFrame:
    """One row (by, name) for each longest run of consecutive rows for which inside holds; name is its length.

    A run is the rows between two breaks, so a running count of breaks numbers the runs.
    """
    inside = F.coalesce(inside, F.lit(False))
    numbered = running_sums(df, by, bucket, order, {"_run": (~inside).cast("long")})
    return numbered.where(inside).groupBy(*by, "_run").agg(F.count(F.lit(1)).alias(name)).drop("_run")
