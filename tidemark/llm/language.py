"""Language identification by blended-spectrum string kernels (operator 9).

A text is the set of its byte n-grams, n from 1 to 4, of lower-cased letters; all
other ASCII counts as a blank. The kernel of two texts is the number of n-grams
that both have, over the root of the product of their numbers; n-grams are told
apart exactly. Kernel ridge regression, one language against the rest, is fitted
on Nyström landmarks; as the kernel is a product of presence vectors, the
landmarks' coefficients fold into one matrix with a row for each n-gram that a
landmark has, by which batches of sparse presence vectors are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, cut, held_out, short_batches, unused
from tidemark.llm.textvec import LETTERS, text_buffers

UNKNOWN = "und"
LONGEST = 4
#: Bytes of text whose presence vectors are made together.
BLOCK = 1 << 20
#: Rows of one block at most; a row, a length and four bytes are one number.
ROWS, SHIFT = 1 << 12, np.uint64(34)
#: Landmarks of all languages, unless there are more languages; kernel columns the driver makes together.
MARKS, CHUNK = 3200, 64

_FOLD = np.where(LETTERS, 32, np.arange(256)).astype(np.uint32)


@dataclass(frozen=True)
class Params:
    """Bounds of what the classifier is fitted on, the ridge, and what is rejected.

    Every labelled language is learned. For each per_lang labelled documents are
    drawn, of which landmarks serve as such; of more than max_langs languages
    each has an equal share of per_lang x max_langs documents, and from
    MARKS / landmarks languages on each has an equal share of MARKS landmarks.
    A text is rejected below min_score, and below the point halfway between the
    score of a text without a known n-gram, one over the number of languages,
    and the low quantile of its language's labelled texts.
    """

    per_lang: int = 400
    max_langs: int = 64
    landmarks: int = 100
    ridge: float = 1e-3
    min_score: float = 0.2
    low: float = 0.02

    def rows_each(self, langs: int) -> int:
        """Labelled documents drawn of each of so many languages."""
        return self.per_lang if langs <= self.max_langs else max(1, self.per_lang * self.max_langs // langs)

    def marks_each(self, langs: int) -> int:
        return max(1, min(self.landmarks, MARKS // langs))


def presence(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row of some rows of a lower-cased text column, in order; where each row's n-grams begin; and the n-grams, ascending, each once a row."""
    d, o = text_buffers(column)
    lo, n = 0, len(o) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(o, o[lo] + BLOCK, "right")) - 1), n, lo + ROWS)
        x = _FOLD[d[o[lo] : o[hi]]]
        row = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(o[lo : hi + 1])) << SHIFT
        code = np.zeros(len(x), np.uint32)
        parts = []
        for k in range(min(LONGEST, len(x))):
            m = len(x) - k
            code = (code[:m] << np.uint32(8)) | x[k:]
            grams = row[:m] | np.uint64(k << 32) | code
            parts.append(grams if not k else grams[row[:m] == row[k:]])
        every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        every.sort()
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        every = every[new]
        yield lo, np.searchsorted(every, np.arange(hi - lo + 1, dtype=np.uint64) << SHIFT), every & np.uint64((1 << 34) - 1)
        lo = hi


def _among(vocabulary: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams are in the (ascending) vocabulary, and the places of those that are."""
    if not len(vocabulary):
        return np.zeros(len(grams), bool), np.zeros(0, int)
    at = np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
    there = vocabulary[at] == grams
    return there, at[there]


def _ready(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the lower-cased text, and whether it has a letter."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text).alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), *more)


@dataclass
class Model:
    langs: list[str]
    vocabulary: np.ndarray  # the n-grams of the landmarks, ascending
    weight: np.ndarray  # n-grams x languages
    bias: np.ndarray
    least: np.ndarray  # score below which a text told as this language is rejected

    def known(self, pred: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Which predictions are not rejected."""
        least = dict(zip(self.langs, self.least.tolist(), strict=True))
        return score >= np.array([least.get(x, 0.0) for x in pred])

    def predict(self, lower: pa.Array, letters: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each lower-cased text."""
        pred, score = np.full(len(lower), UNKNOWN, object), np.zeros(len(lower))
        if self.langs:
            for lo, first, grams in presence(lower):
                rows = len(first) - 1
                there, at = _among(self.vocabulary, grams)
                row = np.repeat(np.arange(rows), np.diff(first))[there]
                sums = np.stack([np.bincount(row, self.weight[at, j], rows) for j in range(len(self.langs))], 1)
                s = sums / np.sqrt(np.maximum(np.diff(first), 1))[:, None] + self.bias
                pred[lo : lo + rows] = np.array(self.langs, object)[s.argmax(1)]
                score[lo : lo + rows] = np.clip((s.max(1) + 1) / 2, 0, 1)
            bare = ~np.array(letters.to_pylist(), bool)
            pred[bare], score[bare] = UNKNOWN, 0
        return pred, score


def kernel_of(rows: list[np.ndarray], marks: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """The kernel of rows and landmarks, both as their n-grams; vocabulary holds the landmarks'."""
    places = [_among(vocabulary, r)[1] for r in rows]
    out = np.zeros((len(rows), len(marks)), np.float32)
    for j in range(0, len(marks), CHUNK):
        some = marks[j : j + CHUNK]
        table = np.zeros((len(vocabulary), len(some)), np.uint8)
        for c, m in enumerate(some):
            table[_among(vocabulary, m)[1], c] = 1
        for i, at in enumerate(places):
            out[i, j : j + CHUNK] = table[at].sum(0, dtype=np.uint32)
    root = lambda x: np.sqrt(np.maximum([len(v) for v in x], 1))
    return out / root(rows)[:, None].astype(np.float32) / root(marks).astype(np.float32)


def fit(docs: DataFrame, p: Params) -> Model:
    """Learn from text and lang of the documents that are not held out.

    least is set by scores that leave the scored text out of the regression, the
    landmarks as they are. One language alone has no other to be told from:
    all its texts score 1, and none is rejected.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"))
    n_langs = known.agg(F.count_distinct("lang")).first()[0]
    drawn = bounded_sample(known, "lang", p.rows_each(n_langs)).select("doc_id", F.col("lang").alias("y"))
    # at most per_lang x max_langs ids, or one a language
    sample = cut(_ready(docs).join(F.broadcast(drawn), "doc_id").where("letters").select("doc_id", "text", "y"), "language-sample")
    langs, counts = zip(*sorted((r["y"], r["count"]) for r in sample.groupBy("y").count().collect()), strict=True) if not sample.isEmpty() else ((), ())
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros(0))
    langs, count = list(langs), np.array(counts)
    first_of = Window.partitionBy("y").orderBy("doc_id", "text")  # a language's drawn rows
    placed = cut(sample.withColumn("place", F.row_number().over(first_of)), "language-places")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, first, grams in presence(batch.column(1)):
                rows = [grams[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(2)[lo : lo + len(rows)], batch.column(3)[lo : lo + len(rows)], pa.array(rows, pa.binary())], names=["y", "place", "x"])

    each = p.marks_each(len(langs))
    got = placed.where(F.col("place") <= each).mapInArrow(own, "y string, place int, x binary").toArrow().sort_by([("y", "ascending"), ("place", "ascending")])
    marks = [np.frombuffer(x.as_buffer(), np.uint64) for x in got.column("x")]
    vocabulary = np.unique(np.concatenate(marks))
    shared = docs.sparkSession.sparkContext.broadcast((marks, vocabulary))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, first, grams in presence(batch.column(1)):
                k = kernel_of([grams[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], *shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(2)[lo : lo + len(k)], batch.column(3)[lo : lo + len(k)], pa.array([r.tobytes() for r in k], pa.binary())], names=["y", "place", "k"])

    # the kernel of the sample and the landmarks: four bytes a pair
    got = placed.mapInArrow(rows_of, "y string, place int, k binary").toArrow().sort_by([("y", "ascending"), ("place", "ascending")])
    kernel = np.frombuffer(b"".join(x.as_buffer() for x in got.column("k")), np.float32).reshape(got.num_rows, -1)
    code = np.repeat(np.arange(len(langs)), count)
    start = np.cumsum(count) - count
    chosen = np.concatenate([np.arange(a, a + min(n, each)) for a, n in zip(start, count, strict=True)])
    y = code
    cut_ = lambda n: [slice(i, min(i + 400, n)) for i in range(0, n, 400)]
    bias = np.full(len(langs), 2 / len(langs) - 1)
    k_mm = kernel[chosen]
    left = (p.ridge * len(langs) * (k_mm + 1e-4 * np.eye(len(chosen)))).astype(np.float64)
    right = np.zeros((len(chosen), len(langs)))
    target = lambda i: np.where(code[i, None] == np.arange(len(langs)), 1.0, -1.0) - bias
    for i in cut_(len(y)):
        k = kernel[i].astype(np.float64)
        weighed = k / count[code[i], None]  # languages weigh the same
        left += k.T @ weighed
        right += weighed.T @ target(i)
    a = np.linalg.solve(left, right)
    inverse = np.linalg.inv(left)
    score = np.empty(len(y))
    for i in cut_(len(y)):
        k = kernel[i].astype(np.float64)
        own = np.clip(((k @ inverse) * k).sum(1) / count[code[i]], 0, 0.999)[:, None]
        alone = (k @ a - own * target(i)) / (1 - own)
        score[i] = np.clip((alone[np.arange(len(k)), code[i]] + bias[code[i]] + 1) / 2, 0, 1)
    floor = 1 / len(langs)
    least = np.array([max(p.min_score, floor + max(0.0, np.quantile(score[code == c], p.low) - floor) / 2) for c in range(len(langs))])
    weight = np.zeros((len(vocabulary), len(langs)))
    for j, m in enumerate(marks):
        weight[_among(vocabulary, m)[1]] += a[j] / np.sqrt(max(len(m), 1))
    return Model(langs, vocabulary, weight.astype(np.float32), bias, least)


def identify(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Predict the language of every whole text.

    Returns doc_id, held_out, lang_pred and score (0 to 1: half of one plus the
    winner's regression value). Texts that are null or have no letter, and all
    texts if nothing was learned, are `und` with score 0. Ties go to the first
    language by name. Repeated rows give repeated results; an empty table gives
    an empty one; other columns are left behind.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            pred, score = m.predict(batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    out = _ready(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents whose language was told and not rejected (see Params); columns stay as they are, whatever their names.

    Every row is judged in its place by its own text, so texts are not shuffled.
    Null texts and those without a letter go; repeated rows fare alike; an empty
    table stays empty.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs, p))
    text = F.col("text").cast("string")
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            pred, score = m.predict(batch.column(n), batch.column(n + 1))
            own = pa.RecordBatch.from_arrays(batch.columns[:n], schema=pa.schema([batch.schema.field(i) for i in range(n)]))
            yield own.filter(pa.array((score >= p.min_score) & m.known(pred, score)))

    lower, letters = unused(docs, "lower", "letters")
    return docs.withColumns({lower: F.lower(text), letters: F.coalesce(text.rlike(r"\p{L}"), F.lit(False))}).mapInArrow(run, docs.schema)
