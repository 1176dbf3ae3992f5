"""Target-distribution importance resampling over hashed word features (operator 11).

Every document becomes a sparse row of counts by bucket; rows are kept as CSR
blocks in the shared folder. Column sums of the blocks give the corpus'
distribution, those of the target's blocks the target's. A bucket's gain is the
floored log ratio of the two, a document's weight the product of its sparse row
with the gains. Weights with Gumbel noise are drawn from the top, which is
sampling without replacement in proportion to exp(weight).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, short_batches
from tidemark.plans.rank import ranked

#: A word: everything but ASCII that is neither digit nor lower-case letter (the text has no A-Z left).
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Buckets of features that a task remembers; beyond it forgets them all.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Params:
    """Features are runs of 1 to grams words; percent of the documents with at least least_words are drawn; seed is that of the noise."""

    grams: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def features(text: str, grams: int) -> tuple[int, Counter]:
    """The number of words, and how often each run of 1 to grams of them occurs."""
    words = WORD.findall(text.translate(_LOWER))
    counts = Counter(words)
    for n in range(2, grams + 1):
        counts.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return len(words), counts


class _Buckets(dict):
    """The bucket of a feature, computed when first asked for."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        b = self[feature] = zlib.crc32(feature.encode()) % self.buckets
        return b


@dataclass
class Csr:
    """Rows of counts: the counts and buckets of row i are those from first[i] to first[i + 1]."""

    first: np.ndarray
    bucket: np.ndarray
    count: np.ndarray

    def column_sums(self, buckets: int) -> np.ndarray:
        return np.bincount(self.bucket, self.count, buckets).astype(np.int64)

    def times(self, vector: np.ndarray) -> np.ndarray:
        """The product with a vector, exact in whole numbers."""
        sums = np.concatenate(([0], np.cumsum(vector[self.bucket] * self.count, dtype=np.int64)))
        return sums[self.first[1:]] - sums[self.first[:-1]]


def counted(texts: list[str | None], known: _Buckets, grams: int) -> tuple[list[int], Csr]:
    """Words of each text, and the rows of counts."""
    words, first, at, n = [], [0], [], []
    for t in texts:
        k, found = features(t or "", grams)
        row: dict[int, int] = {}
        for f, c in found.items():
            b = known[f]
            row[b] = row.get(b, 0) + c
        words.append(k)
        at += row.keys()
        n += row.values()
        first.append(len(at))
    return words, Csr(np.array(first, np.int64), np.array(at, np.int32), np.array(n, np.int64))


_BLOCK = "doc_id array<bigint>, words array<bigint>, first binary, bucket binary, n binary"


def _csr(row: dict) -> Csr:
    return Csr(np.frombuffer(row["first"], np.int64), np.frombuffer(row["bucket"], np.int32), np.frombuffer(row["n"], np.int64))


def blocks(texts: DataFrame, p: Params = Params()) -> DataFrame:
    """CSR blocks of a table of doc_id and text, one a batch of rows.

    A null text has no words. Repeated rows are rows of their own. An empty table
    has no blocks.
    """
    short_batches(texts.sparkSession)
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(p.buckets)
        for b in batches:
            words, m = counted(b.column(1).to_pylist(), known, p.grams)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), "words": pa.array([words], pa.list_(pa.int64())), "first": [m.first.tobytes()], "bucket": [m.bucket.tobytes()], "n": [m.count.tobytes()]})

    return rows.mapInArrow(run, _BLOCK)


def column_sums(matrix: DataFrame, p: Params = Params()) -> np.ndarray:
    """How many features fall in each bucket: a partial sum a task, then one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for b in batches:
            for row in b.to_pylist():
                total += _csr(row).column_sums(p.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"b": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    sums = matrix.select("first", "bucket", "n").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(p.buckets, np.int64)
    for b, n in sums:
        out[b] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(...)) of the ratio of the smoothed shares of each bucket, in doubles."""
    k = len(corpus)
    s, t = float(corpus.sum()) + k, float(target.sum()) + k
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, words, n_features and weight of every row of the blocks. gain is one number a bucket, so it is sent along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                m = _csr(row)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_id"], pa.int64()), "words": pa.array(row["words"], pa.int64()), "n_features": pa.array(m.times(np.ones(len(gain), np.int64)), pa.int64()), "weight": pa.array(m.times(gain), pa.int64())})

    return matrix.mapInArrow(run, "doc_id long, words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document in thousandths, from a digest of the seed and its id; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, p: Params = Params()) -> DataFrame:
    """Every document with n_features, weight, score, and its rank if it is drawn.

    docs has doc_id and text, target has text; other columns are left behind,
    whatever their names. A null or empty text has no features and weight 0. Of
    the N documents with at least least_words words the floor(percent * N / 100)
    of highest score are drawn, ties to the smaller doc_id, a null doc_id last;
    rows of one doc_id and score share places in either order. Without a target
    all gains follow from empty counts; an empty table gives an empty result.
    """
    matrix = cut(blocks(docs, p), "csr")
    wanted = blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), p)
    gain = gains(column_sums(matrix, p), column_sums(wanted, p))
    scored = weights(matrix, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), p.seed)).withColumn("fit", F.col("words") >= p.least_words)
    placed = ranked(scored, [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id")])
    drawn = placed.agg(F.count_if("fit")).first()[0] * p.percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def _sql_words(name: str, source: str) -> str:
    return f"""{name} AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {source})"""


#: The contract's rules in DuckDB, with crc32 as a fold over bytes.
SQL = f"""WITH {_sql_words("d", "documents")}, {_sql_words("m", "(SELECT 0 AS doc_id, text FROM benchmark)")},
 steps AS (SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
 spelt AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM d UNION SELECT w FROM m)),
 bytes AS (SELECT w, list_transform(range(length(h) // 2), lambda j: CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT)) AS b FROM spelt),
 hashed AS (SELECT w, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS k FROM bytes, steps),
 s AS (SELECT k, count(*) AS n FROM d JOIN hashed USING (w) GROUP BY 1), t AS (SELECT k, count(*) AS n FROM m JOIN hashed USING (w) GROUP BY 1),
 gain AS (SELECT r.k, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM d) + 10000.0::DOUBLE) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM m) + 10000.0::DOUBLE)))) AS g FROM range(10000) r(k) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
 each AS (SELECT doc_id, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM d JOIN hashed USING (w) JOIN gain USING (k) GROUP BY 1),
 scored AS (SELECT o.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || o.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM documents o LEFT JOIN each USING (doc_id)),
 placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
 SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM placed"""
