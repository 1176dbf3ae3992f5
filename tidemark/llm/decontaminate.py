"""Benchmark decontamination by spaced-seed hashing (operator 1).

A mask looks at some of a run of words and ignores the others, so a seed still
hits where words at ignored positions were replaced. Hashes of all masks over the
benchmark are joined with those of the documents' words; around each hit the
document is laid along the benchmark item, word by word, and the best run is
found in which an equal word earns 1 and a replaced one costs more. Case is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches, text_only, unused
from tidemark.llm.textvec import Block, blocks, mix, row_numbers

#: The masks: 1 is a word that must be equal, 0 one that is ignored. All have weight 6.
MASKS = ("111111", "1110111", "1101100101", "11010001011", "100110101001")
#: Words of benchmark text that are searched for at once; a larger benchmark takes more passes over the documents.
PASS_WORDS = 2_000_000


@dataclass(frozen=True)
class Params:
    """What counts as a leak: so many equal words in a run, at least this share of the run's words.

    The whole item counts from whole_item equal words on, as short items have no
    more to give.
    """

    min_equal: int = 12
    min_share: float = 0.75
    whole_item: int = 8
    mismatch: float = 2.0


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the words a mask looks at, for each place it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c, out = np.uint64(0xD6E8FEB86659FD93), np.full(n, len(mask) + int(mask, 2), np.uint64)
    for j, x in enumerate(mask):
        if x == "1":
            out = out * c + h[j : j + n]
    return mix(out)


@dataclass
class Searched:
    """Some benchmark items, as every task holds them: at most PASS_WORDS words, or one longer item."""

    items: list[int]
    first: np.ndarray  # of each item's words, and the end
    words: np.ndarray
    seed: np.ndarray  # sorted
    place: np.ndarray  # of the seed's first word, among all words
    bitmap: np.ndarray  # of the seeds' upper 20 bits


def searched(items: list[int], texts: list[str]) -> Searched:
    hashes, first = [], [0]
    for b in blocks(pa.array(texts, pa.large_string())):
        hashes.append(b.hash)
        first += (b.first[1:] + first[-1] - b.first[0]).tolist()
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(items)), np.diff(first))
    seed, place = [], []
    for m in MASKS:
        s = seeds(words, m)
        at = np.flatnonzero(item[: len(s)] == item[len(m) - 1 :][: len(s)])
        seed.append(s[at])
        place.append(at)
    seed, place = np.concatenate(seed), np.concatenate(place)
    order = np.argsort(seed, kind="stable")
    bitmap = np.zeros(1 << 20, bool)
    bitmap[(seed >> np.uint64(44)).astype(np.int64)] = True
    return Searched(items, np.array(first), words, seed[order], place[order], bitmap)


def best_run(equal: np.ndarray, mismatch: float) -> tuple[int, int]:
    """The run start..end with the greatest sum of 1 for equal and -mismatch for other words."""
    total = np.concatenate(([0.0], np.cumsum(np.where(equal, 1.0, -mismatch))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.argmin(total[: end + 1])), end


def longest_run(equal: np.ndarray, share: float) -> tuple[int, int]:
    """The run start..end of the most equal words among those with at least this share of them."""
    total = np.concatenate(([0.0], np.cumsum(equal - share)))
    count = np.concatenate(([0], np.cumsum(equal)))
    highest = np.maximum.accumulate(total[::-1])[::-1]
    end = np.searchsorted(-highest, -(total - 1e-9), "right") - 1  # the last place that is not lower than the start
    lo = int(np.argmax(count[end] - count))
    at = lo + np.flatnonzero(equal[lo : end[lo]])
    return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)


def leaked_runs(equal: np.ndarray, p: Params) -> Iterator[tuple[int, int, int]]:
    """start, end and equal words of the runs that count: the best one, or else the longest; then those left and right of it."""
    todo = [(0, len(equal))]
    while todo:
        a, z = todo.pop()
        x = equal[a:z]
        if x.sum() < max(1, p.min_equal):
            continue
        for lo, hi in (best_run(x, p.mismatch), longest_run(x, p.min_share)):
            n = int(x[lo:hi].sum())
            if n >= p.min_equal and n >= p.min_share * (hi - lo):
                yield a + lo, a + hi, n
                todo += [(a, a + lo), (a + hi, z)]
                break


def hits(b: Block, s: Searched) -> Iterator[tuple[int, int, int]]:
    """row, item (by number) and the place in the row's words where the item's first word would be."""
    row = row_numbers(b)
    found = []
    for m in MASKS:
        h = seeds(b.hash, m)
        at = np.flatnonzero(s.bitmap[(h >> np.uint64(44)).astype(np.int64)])
        at = at[row[at] == row[at + len(m) - 1]]
        low, high = np.searchsorted(s.seed, h[at], "left"), np.searchsorted(s.seed, h[at], "right")
        n = high - low
        if n.sum():
            which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w, p = np.repeat(at, n), s.place[which]
            item = np.searchsorted(s.first, p, "right") - 1
            found.append(np.stack((row[w], item, w - b.first[row[w]] - (p - s.first[item]))))
    if found:
        yield from np.unique(np.concatenate(found, axis=1), axis=1).T.tolist()


def overlaps(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The runs of benchmark items in documents.

    Returns doc_id, item_id, start and end (words of the document), n_equal and
    share (equal words of the run), one row for each place where an item lies in
    a document with at least min_equal equal words (or the whole item). Null,
    empty and very short texts and items give nothing; repeated rows give
    repeated results; equal items each give their own. Empty tables give an empty
    result; other columns are left behind. Only the benchmark is sent to tasks,
    PASS_WORDS words at a time; there is no shuffle of documents.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = text_only(docs).withColumn("text", F.lower("text"))
    out = None
    for items in batches_of(spark, benchmark):
        part = search(docs, items, p)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else search(docs, searched([], []), p)


def batches_of(spark: SparkSession, benchmark: DataFrame) -> Iterator[Searched]:
    """The benchmark in passes. Items come to the driver one pass at a time."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text")).where("text is not null").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += r["text"].count(" ") + 1
        if size >= PASS_WORDS:
            yield searched(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield searched(ids, texts)


def found_in(column: pa.Array, s: Searched, p: Params) -> Iterator[tuple[int, int, int, int, int]]:
    """Row, item, start, end and equal words of each run of an item in a lower-cased text column."""
    for b in blocks(column):
        for row, item, at in hits(b, s):
            a, z = b.row_words(row)
            words = s.words[s.first[item] : s.first[item + 1]]
            skip = max(0, -at)
            here = b.hash[a + at + skip : min(z, a + at + len(words))]
            equal = here == words[skip : skip + len(here)]
            n = int(equal.sum())
            whole = len(equal) == len(words) and n >= p.whole_item and n >= p.min_share * len(words)
            for lo, hi, n_run in leaked_runs(equal, p):
                whole = False  # a run of it is told
                yield b.lo + row, s.items[item], at + skip + lo, at + skip + hi, n_run
            if whole:
                yield b.lo + row, s.items[item], at, at + len(words), n


def search(docs: DataFrame, items: Searched, p: Params) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    names = ["doc_id", "item_id", "start", "end", "n_equal", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            out = [(batch.column(0)[row].as_py(), item, lo, hi, n, n / (hi - lo)) for row, item, lo, hi, n in found_in(batch.column(1), s, p)]
            if out:
                cols = list(zip(*out, strict=True))
                types = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.mapInArrow(run, "doc_id long, item_id long, start long, end long, n_equal long, share double")


def clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents without those that hold a run of a benchmark item; columns stay as they are, whatever their names.

    Every row is judged in its place by its own text, so texts are not shuffled.
    Null and empty texts stay; repeated rows fare alike; null and empty items
    take nothing away; an empty table stays empty, an empty benchmark lets all stay.
    """
    spark = docs.sparkSession
    short_batches(spark)
    out = docs
    for items in batches_of(spark, benchmark):
        out = without(out, items, p)
    return out


def without(docs: DataFrame, items: Searched, p: Params) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, *_ in found_in(batch.column(n), shared.value, p):
                keep[row] = False
            own = pa.RecordBatch.from_arrays(batch.columns[:n], schema=pa.schema([batch.schema.field(i) for i in range(n)]))
            yield own.filter(pa.array(keep))

    (lower,) = unused(docs, "lower")
    return docs.withColumn(lower, F.lower(F.col("text").cast("string"))).mapInArrow(run, docs.schema)
