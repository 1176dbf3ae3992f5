"""Token counts from flat token files without an index, by scanning for separators (operator 6).

A flat file is nothing but little-endian unsigned 16-bit ids. Id 0 ends a
document; before it stand TRAILER ids that spell the document's doc_id, so a file
needs no index to say whose tokens it holds. Every task writes its own rows as
one stream, cut into shards of a bounded size wherever they are full; documents
run on from shard to shard. Blocks of the shards are searched for the separator
by numpy, all at once; a prefix scan over the blocks' totals then stitches the
documents that cross blocks and shards. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoder
from tidemark.llm.common import cut, partitions, shared_dir, short_batches, strings, text_only

#: Ids in a block, and in a shard (16 MB).
BLOCK_IDS, SHARD_IDS = 1 << 18, 1 << 23
#: The separator, and what is added to a tokenizer's id so that none equals it.
END, SHIFT = 0, 1
#: Ids that spell a doc_id: its digits to the base BASE, lowest first, each SHIFT more; the last one is NULL if it is null.
TRAILER, BASE, NULL = 5, 65535, 9

BYTE_50K = "byte_bpe_50k.tiktoken"


def trailers(doc_ids: pa.Array) -> np.ndarray:
    """The ids that end each document: TRAILER ids of its doc_id, then the separator."""
    x = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    out = np.zeros((len(x), TRAILER + 1), "<u2")
    for k in range(TRAILER):
        out[:, k] = x % np.uint64(BASE) + np.uint64(SHIFT)
        x = x // np.uint64(BASE)
    out[doc_ids.is_null().to_numpy(zero_copy_only=False), TRAILER - 1] = NULL + SHIFT
    return out


def doc_ids_at(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The doc_ids spelt before the separators at ends."""
    out = np.zeros(len(ends), np.uint64)
    for k in reversed(range(TRAILER)):
        out = out * np.uint64(BASE) + (ids[ends - TRAILER + k].astype(np.uint64) - np.uint64(SHIFT))
    return pa.array(out.view(np.int64), mask=ids[ends - 1] == NULL + SHIFT)


def write_flat(docs: DataFrame, ranks_path: str, path: str, shard_ids: int = SHARD_IDS) -> None:
    """Write every document's ids, each task its rows in their order as shards of shard_ids ids.

    A shard ends earlier only where it would part a trailer from its separator.
    Spark's text writer ends each shard with one line feed, an odd byte that
    readers drop. Null and empty texts are a trailer and a separator alone.
    """
    spark = docs.sparkSession
    short_batches(spark)
    whole = (TRAILER + 1) * 2
    if shard_ids * 2 < whole:
        raise ValueError("a shard must hold a trailer and a separator")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path)
        if len(bpe.bytes_of) + SHIFT > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        held = bytearray()
        for batch in batches:
            for text, end in zip(strings(batch, "text"), trailers(batch.column(0)), strict=True):
                held += (np.frombuffer(bpe.encode(text), "<u4") + SHIFT).astype("<u2").tobytes() + end.tobytes()
                while len(held) > shard_ids * 2:
                    stop = min(shard_ids * 2, len(held) - whole)
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(held[:stop])], pa.binary())], names=["shard"])
                    del held[:stop]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], names=["shard"])

    rows = text_only(docs).mapInArrow(run, "shard binary").select(F.col("shard").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", 1).text(path)


def scan_blocks(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row a block: task and shard that it is of, block, n ids, where in it separators stand, and whose they are.

    Shards are read by as many tasks as their sizes call for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u2", len(content.as_buffer()) // 2)
                for k, at in enumerate(range(0, len(ids), block_ids)):
                    part = ids[at : at + block_ids]
                    ends = np.flatnonzero(part == END)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task], pa.int32()), pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([ends.astype(np.int32)], pa.list_(pa.int32())), pa.array([doc_ids_at(ids, at + ends)], pa.list_(pa.int64()))],
                        names=["task", "shard", "block", "n", "ends", "doc_ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("int")
    files = files.select(number(r"/part-(\d+)-[^/]*$").alias("task"), number(r"-c(\d+)\.[^/]*$").alias("shard"), "content")
    return files.mapInArrow(run, "task int, shard int, block int, n long, ends array<int>, doc_ids array<long>")


def stitch(blocks: DataFrame) -> DataFrame:
    """The documents of scanned blocks: doc_id, n_tokens, and task and place, where its first id is in its task's stream.

    Ids and the last separator before each block come from a prefix scan over the
    blocks of its task, some megabytes each; streams of other tasks do not meet it.
    """
    before = Window.partitionBy("task").orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.withColumn("id0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    b = b.withColumn("prev", F.coalesce(F.max(F.when(F.size("ends") > 0, F.col("id0") + F.try_element_at("ends", F.lit(-1)))).over(before), F.lit(-1)))
    each = b.select("task", "id0", "prev", "ends", "doc_ids", F.posexplode("ends").alias("k", "end"))
    first = F.when(F.col("k") == 0, F.col("prev")).otherwise(F.col("id0") + F.try_element_at("ends", F.col("k"))) + 1
    return each.select(F.get("doc_ids", F.col("k")).alias("doc_id"), (F.col("id0") + F.col("end") - first - TRAILER).alias("n_tokens"), "task", first.alias("place"))


def starts(found: DataFrame) -> DataFrame:
    """doc_id, start (n_tokens of all rows before it) and n_tokens, in ascending doc_id order, nulls first.

    Rows sharing a doc_id follow each other by n_tokens and by their place in the
    files. Rows are dealt by ranges of all of these, so that no doc_id is too
    frequent for a task; the ranges' own prefix scan has one row each.
    """
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "task", "place"]
    dealt = cut(found.repartitionByRange(partitions(found.sparkSession), *order).withColumn("range", F.spark_partition_id()), "token-counts")
    totals = dealt.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    offsets = totals.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    each = dealt.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return each.join(F.broadcast(offsets), "range").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens")


def token_counts(docs: DataFrame, ranks_path: str, block_ids: int = BLOCK_IDS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the documents as flat token files, then count each document's tokens from the files alone.

    Returns doc_id, start (tokens of all documents before it by ascending doc_id,
    nulls first) and n_tokens, without separators and trailers. Null and empty
    texts have 0 tokens; a very long text runs over several shards. Rows that
    share a doc_id each keep a row of their own, ordered by n_tokens. An empty
    table gives an empty result; other columns are left behind, whatever their
    names.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "flat-tokens")
    write_flat(docs, ranks_path, path, shard_ids)
    return starts(stitch(scan_blocks(spark, path, block_ids)))


def production(docs: DataFrame) -> DataFrame:
    return token_counts(docs, public_tokenizers.path(BYTE_50K))
