"""Document fingerprints by I-Match over several randomised lexicon subsets (operator 4).

Terms are whitespace-separated words with A-Z lower-cased. The lexicon holds
all terms whose document frequency lies in a band, given as shares of the documents. Every subset is a random draw from the whole lexicon,
each term by its own hash and independent of the other subsets, so subsets overlap; they come in levels of falling
density, so that short and very long texts both meet subsets of a few terms.
For each subset a text's distinct terms are sorted and their sequence is hashed; a fingerprint is
the row of these hashes, with dashes where a text has no term of the subset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_bounds, id_bucket, partitions, short_batches, text_only
from tidemark.llm.textvec import blocks, mix

#: Hex digits of a subset's hash.
DIGITS = 6
#: Distinct terms a task holds before it passes its counts on.
HELD = 1_000_000
_SEED = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    """The band of document frequency, and the subsets.

    A subset of level k has a term with probability 1 / (per_level * thinning**k).
    The lexicon is broadcast: it has at most (mean number of distinct terms a
    document) / low entries of some 12 bytes, however many documents there are.
    """

    low: float = 0.0005
    high: float = 0.25
    per_level: int = 32
    levels: int = 3
    thinning: int = 4

    @property
    def subsets(self) -> int:
        return self.per_level * self.levels

    def density(self, subset: int) -> float:
        return 1 / (self.per_level * self.thinning ** (subset // self.per_level))


@dataclass
class Lexicon:
    """The terms of the band, and the subsets that each is in."""

    terms: np.ndarray  # sorted hashes
    first: np.ndarray  # of each term's subsets, and the end
    subsets: np.ndarray


def drawn(terms: np.ndarray, p: Params) -> Lexicon:
    """The lexicon of some sorted terms with its subsets."""
    each = [np.flatnonzero(mix(terms ^ mix(np.array([k + 1], np.uint64) * _SEED)) < np.uint64(min(p.density(k), 1 - 2**-53) * 2**64)) for k in range(p.subsets)]
    of, subset = np.concatenate(each), np.repeat(np.arange(p.subsets), [len(x) for x in each])
    order = np.argsort(of, kind="stable")
    return Lexicon(terms, np.searchsorted(of[order], np.arange(len(terms) + 1)), subset[order].astype(np.int64))


def sequence_hashes(cell: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells and a hash of the sequence of each one's terms, in the order they come in."""
    if not len(cell):
        return cell, terms
    order = np.argsort(cell, kind="stable")
    cell, terms = cell[order], terms[order]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.append(first, len(cell)))
    power = np.cumprod(np.append(np.uint64(1), np.full(int(size.max()), _SEED)), dtype=np.uint64)
    place = np.arange(len(cell)) - np.repeat(first, size)
    return cell[first], mix(np.add.reduceat(mix(terms) * power[place], first) + size.astype(np.uint64))


def _distinct(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of row and term, sorted."""
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], h[new]


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of a text column: its rows, and its distinct terms by row."""
    for b in blocks(column):
        row = np.repeat(np.arange(b.hi - b.lo), np.diff(b.first))
        yield b.lo, b.hi, *_distinct(row, b.hash)


def lexicon(docs: DataFrame, p: Params) -> Lexicon:
    """The terms in the band, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        some: list[np.ndarray] = []
        size = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            k, n = np.unique(np.concatenate(some), return_counts=True)
            both, at = np.unique(np.concatenate((keys, k)), return_inverse=True)
            return both, np.bincount(at, np.concatenate((counts, n))).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["term", "n"])

        for batch in batches:
            for _, _, _, h in _terms(batch.column(0)):
                some.append(h)
                size += len(h)
            if size > HELD:
                keys, counts = merge()
                some, size = [], 0
                if len(keys) > HELD:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        if some:
            keys, counts = merge()
        if len(keys):
            yield out()

    n = docs.count()
    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    low, high = max(2.0, p.low * n), max(2.0, p.high * n)
    terms = found.where((F.col("n") >= low) & (F.col("n") <= high)).select("term").toArrow()
    return drawn(np.sort(terms.column("term").to_numpy().view(np.uint64)), p)


def sketch(column: pa.Array, lex: Lexicon, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the hash of its terms in each subset, which of these are there, and the hash of all words."""
    rows = len(column)
    value = np.zeros(rows * p.subsets, np.uint64)
    there = np.zeros(rows * p.subsets, bool)
    whole = np.zeros(rows, np.uint64)
    for b in blocks(column):
        row = np.repeat(np.arange(b.lo, b.hi), np.diff(b.first))
        r, h = _distinct(row, b.hash)
        if len(lex.terms):
            at = np.minimum(np.searchsorted(lex.terms, h), len(lex.terms) - 1)
            inside = lex.terms[at] == h
            r1, h1, at = r[inside], h[inside], at[inside]
            n = lex.first[at + 1] - lex.first[at]
            which = np.repeat(lex.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell, found = sequence_hashes(np.repeat(r1, n) * p.subsets + lex.subsets[which], np.repeat(h1, n))
            value[cell], there[cell] = found, True
        bare = ~there.reshape(rows, -1)[r].any(1)  # nothing of the lexicon in it: its distinct words stand for it
        cell, found = sequence_hashes(r[bare], h[bare])
        whole[cell] = found
    return value.reshape(rows, -1) >> np.uint64(64 - 4 * DIGITS), there.reshape(rows, -1), whole


def likeness(a: tuple, i: int, b: tuple, j: int) -> float:
    """The share of subsets with equal hashes among those of which either text has terms."""
    either = a[1][i] | b[1][j]
    n = int(either.sum())
    if not n:
        return float(a[2][i] == b[2][j])
    return float((a[1][i] & b[1][j] & (a[0][i] == b[0][j])).sum() / n)


def text_of(s: tuple, i: int) -> str:
    """The fingerprint as a string."""
    if not s[1][i].any():
        return f"words:{int(s[2][i]):016x}"
    return "".join(f"{v:06x}" if t else "-" * DIGITS for v, t in zip(s[0][i].tolist(), s[1][i].tolist(), strict=True))


def neighbours(docs: DataFrame) -> DataFrame:
    """The documents dealt by ranges of doc_id, each range followed by the first row of the next one.

    Columns doc_id, text, borrowed; in a task rows are sorted by borrowed, doc_id
    (null first) and text, so that the document after a row is the next row. The
    last range borrows the first document of all.
    """
    spark = docs.sparkSession
    bounds = id_bounds(docs, partitions(spark))
    dealt = docs.withColumn("bucket", id_bucket(F.col("doc_id"), bounds))
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("low")).orderBy("bucket").collect()
    # one row a range, not a document: as many as there are shuffle partitions at most
    ids = [r["low"]["doc_id"] for r in firsts]
    to = [firsts[k - 1]["bucket"] for k in range(len(firsts))]
    loans = spark.createDataFrame(list(zip(ids, to, strict=True)), "first long, lender int")
    both = dealt.join(F.broadcast(loans), F.col("doc_id").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("borrowed"))
    lent = F.when(F.col("lender").isNotNull(), F.struct(F.col("lender").alias("bucket"), F.lit(True).alias("borrowed")))
    each = both.select("doc_id", "text", F.explode(F.array_compact(F.array(own, lent))).alias("at")).select("doc_id", "text", "at.bucket", "at.borrowed")
    return each.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("borrowed", F.col("doc_id").asc_nulls_first(), "text").select("doc_id", "text", "borrowed")


def fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Fingerprint every whole text and its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document by doc_id; the last document's
    next is the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next. A null text is empty. Texts
    without a lexicon term, the empty one among them, are fingerprinted by their
    distinct words, and are like only what has the same. Rows sharing a doc_id
    follow each other by text; null ids come first; a lone document is its own
    next; an empty table gives an empty result; other columns are left behind.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = text_only(docs)
    shared = spark.sparkContext.broadcast(lexicon(docs, p))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        ids: list = []
        texts: list[str] = []
        borrowed: list[bool] = []
        done = False
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts += [x or "" for x in batch.column(1).to_pylist()]
            borrowed += batch.column(2).to_pylist()
            n = len(ids) - 1  # rows whose next row is here
            if n < 1 or done:
                continue
            if any(borrowed):
                n, done = borrowed.index(True), True  # rows after it share the borrowed row's id
            edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in zip(texts[:n], texts[1 : n + 1], strict=True)]
            own, new = sketch(pa.array(texts[: n + 1], pa.large_string()), lex, p), sketch(pa.array(edited, pa.large_string()), lex, p)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:n], pa.int64()),
                    pa.array([len(t) for t in texts[:n]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([text_of(own, i) for i in range(n)], pa.string()),
                    pa.array([text_of(new, i) for i in range(n)], pa.string()),
                    pa.array([likeness(own, i, new, i) for i in range(n)], pa.float64()),
                    pa.array([likeness(own, i, own, i + 1) for i in range(n)], pa.float64()),
                ],
                names=names,
            )
            ids, texts, borrowed = ids[n:], texts[n:], borrowed[n:]

    return neighbours(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
