"""Bar archives that are changed by commits (SNK2, SNK3, DQ8).

    data/commit=.../symbol=.../month=...    bars, written once and never changed
    manifests/number=...                    which commit holds each symbol and month

A commit rewrites the months that new bars touch, as files of its own, and
writes the next manifest last. Readers go by the newest manifest, so a load that
breaks off leaves what was there, months that no new bar touches keep their
files, and of two loads at once only one can write the next manifest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality

BARS = "symbol string, epoch_s long, open double, high double, low double, close double, tick_volume long"
MANIFEST = "symbol string, month string, commit string, bars long, from_s long, to_s long, digest string, source string, complete boolean, number int"
_KEY = ["symbol", "month"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest: a row for each symbol and month; empty where nothing was committed."""
    at = f"{path}/manifests"
    if not _exists(spark, at):
        return spark.createDataFrame([], MANIFEST)
    every = spark.read.schema(MANIFEST).parquet(at)
    newest = every.agg(F.max("number")).first()[0]
    return every.where(F.col("number") == F.lit(newest if newest is not None else -1))


def _with_month(bars: DataFrame) -> DataFrame:
    return bars.withColumn("month", F.date_format(F.timestamp_seconds("epoch_s"), "yyyy-MM"))


def read(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """The bars of the newest manifest; only, a table of symbols and months, prunes the folders that are read."""
    m = manifest(spark, path)
    if only is not None:
        m = m.join(only, _KEY, "left_semi")
    if not _exists(spark, f"{path}/data"):
        return spark.createDataFrame([], BARS)
    rows = spark.read.schema(f"{BARS}, month string, commit string").parquet(f"{path}/data")
    return rows.join(m.select("commit", *_KEY), ["commit", *_KEY], "left_semi").select([x.split()[0] for x in BARS.split(", ")])


def commit(new: DataFrame, path: str, source: str = "", full_days: int = 360) -> DataFrame:
    """Merge bars into an archive, of each time the new one, and return the manifest that says so (SNK2, SNK3).

    new has one row a symbol and time. A month's digest is that of its bars in
    order; complete is whether a symbol's archive spans full_days. No new bars
    leave all as it is.
    """
    spark = new.sparkSession
    names = [x.split()[0] for x in BARS.split(", ")]
    new = _with_month(new.select(*[F.col(n).cast(t) for n, t in (x.split() for x in BARS.split(", "))]))
    touched = new.select(*_KEY).distinct()
    before = manifest(spark, path)
    newest = before.agg(F.max("number")).first()[0]
    number = 0 if newest is None else newest + 1
    merged = _with_month(quality.upsert(read(spark, path, touched), new.select(*names), ["symbol"]))
    at = uuid.uuid4().hex[:12]
    merged.repartition(*_KEY).write.partitionBy(*_KEY).parquet(f"{path}/data/commit={at}")
    if not _exists(spark, f"{path}/data/commit={at}/_SUCCESS"):
        raise OSError(f"commit {at} is not whole")
    done = spark.read.schema(f"{BARS}, month string").parquet(f"{path}/data/commit={at}")
    digests = quality.fingerprint(done, _KEY, "bars")
    stats = done.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("bars"), F.min("epoch_s").alias("from_s"), F.max("epoch_s").alias("to_s")).join(digests, _KEY)
    stats = stats.select(*_KEY, F.lit(at).alias("commit"), "bars", "from_s", "to_s", F.col("fingerprint").alias("digest"), F.lit(source).alias("source"))
    kept = before.join(touched, _KEY, "left_anti").select(*stats.columns)
    every = kept.unionByName(stats)
    spans = every.groupBy("symbol").agg(((F.max("to_s") - F.min("from_s")) / 86400 >= full_days).alias("complete"))
    rows = every.join(spans, "symbol")
    if rows.isEmpty():
        return before
    rows.coalesce(1).write.parquet(f"{path}/manifests/number={number}")  # a row a month of a symbol; fails where another load was first
    return manifest(spark, path)


def refresh(source: DataFrame, path: str, start: int, end: int, requested_days: int = 360, slack: int = 2 * 86400, signed: bool = False) -> DataFrame:
    """Load what an archive lacks of start..end, commit it cleaned, and return the audit of the whole archive (DQ8).

    source has seq, the order of arrival. What is missing is told by the
    manifest's spans: head, tail, or all of a symbol that is not held. signed is
    for sources whose prices may be nothing or below.
    """
    spark = source.sparkSession
    spans = manifest(spark, path).groupBy("symbol").agg(F.min("from_s").alias("_lo"), F.max("to_s").alias("_hi"))
    head = (F.lit(start) < F.col("_lo") - slack) & (F.col("epoch_s") <= F.col("_lo"))
    tail = (F.lit(end) > F.col("_hi") + slack) & (F.col("epoch_s") >= F.col("_hi"))
    wanted = source.where(F.col("epoch_s").between(start, end)).join(spans, "symbol", "left").where(F.col("_lo").isNull() | head | tail).drop("_lo", "_hi")
    commit(quality.clean(wanted, ["symbol"], signed), path)
    return quality.audit(read(spark, path).withColumn("seq", F.col("epoch_s")), ["symbol"], requested_days, signed)
