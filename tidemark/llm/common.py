"""What the corpus operators share: the shared folder, cut lineage, ranges of doc_id, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in one Arrow batch; texts can be long, so batches are kept short.
BATCH_ROWS = 512


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-shared-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    The cluster names it in spark.checkpoint.dir. Only on one machine, as in
    tests, a temporary folder takes its place where that is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + _own_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after those that df has columns of."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string (null stays null), other columns left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def bounded_batches(spark: SparkSession, mb: int = 16) -> None:
    """Short batches that also hold few bytes, for rows that are whole blocks."""
    short_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if sum(x.num_rows for x in held):
        yield pa.concat_batches(held)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of rows that no learner may see: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def id_bounds(docs: DataFrame, n: int) -> list[float]:
    """Up to n - 1 ascending ids that cut the documents into ranges of about equal count."""
    if n < 2:
        return []
    found = docs.select(F.col("doc_id").cast("double").alias("d")).where("d is not null").approxQuantile("d", [i / n for i in range(1, n)], 1 / (8 * n))
    return sorted({*found})


def id_bucket(doc_id: Column, bounds: list[float]) -> Column:
    """The number of bounds that are at most doc_id; null ids come first."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(b) for b in bounds])
    return F.coalesce(F.size(F.filter(steps, lambda b: b <= doc_id.cast("double"))), F.lit(0))


def arrow_table(schema: str, columns: dict) -> pa.RecordBatch:
    """A record batch of the named columns, typed by numpy or given as Arrow arrays."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as a list of str; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def bounded_sample(rows: DataFrame, by: str, cap: Column | int) -> DataFrame:
    """At most cap rows of each value of by, those of the smallest hash of doc_id; cap may depend on by.

    Rows of a value are counted first, and only those whose hash is small enough
    to be among the first cap or not far beyond are ranked, so a frequent value
    sends a small multiple of its cap to one task.
    """
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_cap", cap if isinstance(cap, Column) else F.lit(cap))
    # four times the share that is wanted, and 64 rows: fewer than cap rows pass as good as never
    share = (4 * F.col("_cap") + 64) / F.col("_rows")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / float(1 << 63)
    some = rows.join(sizes, by).where(draw < share)
    w = Window.partitionBy(by).orderBy(F.xxhash64("doc_id"), "doc_id")
    return some.withColumn("_place", F.row_number().over(w)).where("_place <= _cap").drop("_place", "_rows", "_cap")
