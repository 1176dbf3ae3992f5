"""Vector code compression: product codebooks by Lloyd's rounds over heaps (operator 12).

Vectors are cut into equal parts, and every part position has a codebook. A full
scan gives each part its nearest entry, the distance to it (upper) and to the
second nearest (lower). While entries move, upper grows by at most its own
entry's drift and lower shrinks by at most the largest drift of the others, so
lower - upper shrinks by at most a drift that is the same for all parts of an
entry. Each block of vectors keeps one heap an entry, keyed by lower - upper plus
the entry's cumulative drift when the part was put in. A part's nearest entry can
have changed only if its key is at most the cumulative drift of now; these are
the heap's top, and they alone are popped and scanned again, exactly, in whole
numbers. A heap is kept as an ascending array, of which a prefix is popped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, gathered, partitions

#: What rounding may add to a bound, as a share of it.
ROUNDING = 1e-9
#: Vectors of a block.
BLOCK = 4096


@dataclass(frozen=True)
class Params:
    """parts a vector, entries a codebook (at most 256), rounds, and the factor that makes components whole numbers."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


@dataclass
class Books:
    """All codebooks (part, entry, position) with what they have drifted: cumulative, by part and entry."""

    entries: np.ndarray
    drift: np.ndarray

    def moved(self, new: np.ndarray) -> Books:
        """The codebooks after a round. An entry's parts lose its own drift and the largest of the others'."""
        d = np.sqrt(((new - self.entries).astype(float) ** 2).sum(2)) * (1 + ROUNDING)
        if d.shape[1] > 1:
            top = np.sort(d, 1)
            others = np.where(d == top[:, -1:], np.where((d == top[:, -1:]).sum(1, keepdims=True) > 1, top[:, -1:], top[:, -2:-1]), top[:, -1:])
        else:
            others = np.zeros_like(d)
        return Books(new, (self.drift + d + others) * (1 + ROUNDING))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


@dataclass
class Heaps:
    """The heaps of one block: place holds parts (vector * parts + part), key their keys, both ascending within a heap; first begins each heap, by part and entry."""

    first: np.ndarray
    place: np.ndarray
    key: np.ndarray

    @classmethod
    def of(cls, heap: np.ndarray, place: np.ndarray, key: np.ndarray, heaps: int) -> Heaps:
        order = np.lexsort((place, key, heap))
        return cls(np.searchsorted(heap[order], np.arange(heaps + 1)), place[order].astype(np.int32), key[order])

    def pop(self, until: np.ndarray) -> np.ndarray:
        """Take out what is at most until in each heap."""
        sizes = np.diff(self.first)
        n = np.array([np.searchsorted(self.key[a:b], u, side="right") for a, b, u in zip(self.first[:-1], self.first[1:], until, strict=True)], int)
        at = np.arange(len(self.place)) - np.repeat(self.first[:-1], sizes)
        top = at < np.repeat(n, sizes)
        out = self.place[top]
        self.place, self.key = self.place[~top], self.key[~top]
        self.first = np.concatenate(([0], np.cumsum(sizes - n)))
        return out

    def push(self, heap: np.ndarray, place: np.ndarray, key: np.ndarray) -> None:
        heaps = len(self.first) - 1
        old = np.repeat(np.arange(heaps), np.diff(self.first))
        merged = Heaps.of(np.concatenate((old, heap)), np.concatenate((self.place, place)), np.concatenate((self.key, key)), heaps)
        self.first, self.place, self.key = merged.first, merged.place, merged.key


@dataclass
class Block:
    """Some vectors: their parts (vector, part, position), each part's entry, and the heaps."""

    parts: np.ndarray
    entry: np.ndarray
    heaps: Heaps | None = None
    scanned: int = 0
    delta: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n, d) from entries (k, d), in whole numbers."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j : j + 1] - entries[:, j]
        out += d * d
    return out


def _scan(block: Block, places: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries of some parts (ties to the lower one) and their keys."""
    m, k, _ = books.entries.shape
    entry, key = np.zeros(len(places), np.int64), np.full(len(places), np.inf)
    part = places % m
    for j in range(m):
        mine = np.flatnonzero(part == j)
        if len(mine):
            d = distances(block.parts[places[mine] // m, j], books.entries[j])
            e = d.argmin(1)
            entry[mine] = e
            if k > 1:
                rows = np.arange(len(mine))
                upper = np.sqrt(d[rows, e].astype(float))
                d[rows, e] = np.iinfo(np.int64).max
                lower = np.sqrt(d.min(1).astype(float))
                key[mine] = lower - upper - ROUNDING * (lower + upper) + books.drift[j, e]
    return entry, key


def assign(block: Block, books: Books, keep: bool = True) -> None:
    """Bring a block up to its codebooks: all parts the first time, afterwards those that the heaps give up.

    delta becomes what that changes in the sums and counts of the entries: an
    array (part, entry, position and count). keep prepares for another round.
    """
    m, k, d = books.entries.shape
    n = len(block.parts)
    if block.heaps is None:
        places, was = np.arange(n * m), None
    else:
        places = block.heaps.pop(books.drift.reshape(-1)).astype(np.int64)
        was = block.entry.reshape(-1)[places].astype(np.int64)
    entry, key = _scan(block, places, books)
    block.scanned = len(places)
    heap = places % m * k + entry
    x = block.parts.reshape(n * m, d)[places]
    delta = np.zeros((m * k, d + 1), np.int64)
    if was is None:
        _add(delta, heap, x)
    else:
        other = entry != was
        _add(delta, heap[other], x[other])
        _add(delta, (places % m * k + was)[other], x[other], -1)
    block.delta = delta
    block.entry.reshape(-1)[places] = entry
    if keep:
        if block.heaps is None:
            block.heaps = Heaps.of(heap, places, key, m * k)
        else:
            block.heaps.push(heap, places, key)


def _add(delta: np.ndarray, heap: np.ndarray, x: np.ndarray, sign: int = 1) -> None:
    np.add.at(delta[:, -1], heap, sign)
    for j in range(x.shape[1]):
        np.add.at(delta[:, j], heap, sign * x[:, j])


def _vector(name: str, factor: int) -> Column:
    """The whole numbers of a vector column."""
    return F.transform(name, lambda x: F.floor(F.lit(factor) * x.cast("double")))


def padded(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of one width, filled with zeros."""
    x = np.zeros((len(lists), width), np.int64)
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists)), size)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return x


def usable(name: str) -> Column:
    """True for a vector that is there and whose components are all numbers, none infinite."""
    bad = F.exists(name, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(name).isNotNull() & ~bad


def kept(rows: DataFrame, p: Params) -> DataFrame:
    """vec_id, label (as it is) and v, whole numbers, of the rows with a usable vector."""
    return rows.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), _vector("embedding", p.scale).alias("v"))


def first_books(rows: DataFrame, width: int, p: Params) -> Books:
    """The parts of the vectors of the smallest ids: at most as many rows as a codebook has entries come to the driver."""
    some = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(p.entries).select("v").collect()
    e = np.array([r["v"] + [0] * (width - len(r["v"])) for r in some], np.int64).reshape(len(some), p.parts, width // p.parts)
    e = np.ascontiguousarray(e.transpose(1, 0, 2))
    return Books(e, np.zeros(e.shape[:2]))


#: The state of a block between rounds.
_STATE = "parts binary, entry binary, first binary, place binary, key binary, delta binary, scanned long"


def _batch(ids: pa.Array, labels: pa.Array, b: Block) -> pa.RecordBatch:
    """A block as one row."""
    whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    h = b.heaps or Heaps(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))
    raw = [b.parts.tobytes(), b.entry.tobytes(), h.first.astype(np.int64).tobytes(), h.place.tobytes(), h.key.tobytes(), b.delta.tobytes()]
    return pa.RecordBatch.from_arrays([whole(ids), whole(labels), *[pa.array([x], pa.binary()) for x in raw], pa.array([b.scanned], pa.int64())], names=["ids", "labels", "parts", "entry", "first", "place", "key", "delta", "scanned"])


def _blocks(batches: Iterator[pa.RecordBatch], m: int, width: int) -> Iterator[tuple[pa.Array, pa.Array, Block]]:
    """The blocks of rows of state."""
    for batch in batches:
        for i in range(batch.num_rows):
            parts, entry, first, place, key = (batch.column(c)[i].as_py() for c in range(2, 7))
            heaps = Heaps(np.frombuffer(first, np.int64), np.frombuffer(place, np.int32), np.frombuffer(key, float))
            yield batch.column(0)[i].values, batch.column(1)[i].values, Block(np.frombuffer(parts, np.int64).reshape(-1, m, width // m), np.frombuffer(entry, np.uint8).reshape(-1, m).copy(), heaps)


def _started(rows: DataFrame, books: Books, width: int) -> DataFrame:
    """Blocks of the vectors, one a batch, after the first assignment."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    m = books.entries.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, BLOCK):
            block = Block(padded(b.column(2), width).reshape(b.num_rows, m, width // m), np.zeros((b.num_rows, m), np.uint8))
            assign(block, shared.value)
            yield _batch(b.column(0), b.column(1), block)

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"ids array<bigint>, labels array<{kind}>, {_STATE}")


def _again(state: DataFrame, books: Books, width: int) -> DataFrame:
    """The same blocks after the next assignment."""
    shared = state.sparkSession.sparkContext.broadcast(books)
    m = books.entries.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, block in _blocks(batches, m, width):
            assign(block, shared.value)
            yield _batch(ids, labels, block)

    return state.mapInArrow(run, state.schema)


def deltas(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The sum of the blocks' deltas: one array a task, then one row a component of an entry."""
    m, k, d = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m * k * (d + 1), np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(m * k * (d + 1), np.int64)
    for at, n in state.select("delta").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[at] = n
    return out.reshape(m, k, d + 1)


def _coded(state: DataFrame, books: Books, width: int) -> DataFrame:
    """vec_id, label, code and error of every vector after the last assignment."""
    shared = state.sparkSession.sparkContext.broadcast(books)
    m = books.entries.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, block in _blocks(batches, m, width):
            assign(block, shared.value, keep=False)
            error = np.zeros(len(block.parts), np.int64)
            for j in range(m):
                d = block.parts[:, j] - shared.value.entries[j][block.entry[:, j]]
                error += (d * d).sum(1)
            codes = [row.tobytes().hex() for row in block.entry]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = state.schema["labels"].dataType.elementType.simpleString()
    return state.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint")


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors summed over equal labels.

    A label of many rows must not meet in one task: labels that hold more than
    an even share of the rows are at most as many as there are partitions and
    are broadcast; the rows of all others are joined by label.
    """
    p = partitions(coded.sparkSession)
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "label-errors")
    n = sums.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    big = sums.where(F.col("rows") > n / p).select(F.col("label").alias("_label"), "label_error")
    small = sums.where(F.col("rows") <= n / p).select(F.col("label").alias("_label"), F.col("label_error").alias("_error"))
    some = coded.join(F.broadcast(big), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    done = some.where("label_error IS NOT NULL")
    rest = some.where("label_error IS NULL").drop("label_error")
    joined = rest.join(small, F.col("label").eqNullSafe(F.col("_label"))).withColumnRenamed("_error", "label_error").drop("_label")
    return done.unionByName(joined)


def trained(rows: DataFrame, p: Params = Params()) -> tuple[DataFrame, Books, int]:
    """The blocks after the last round, the final codebooks, and the width of the vectors; rows are those of kept()."""
    if p.entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    bounded_batches(rows.sparkSession)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    width = -(-width // p.parts) * p.parts
    books = first_books(rows, width, p)
    if not books.entries.size:
        books = Books(np.zeros((p.parts, 1, width // p.parts), np.int64), np.zeros((p.parts, 1)))
    m, k, d = books.entries.shape
    total = np.zeros((m, k, d + 1), np.int64)
    state = cut(_started(rows, books, width), "codes")
    for i in range(p.rounds):
        total += deltas(state, (m, k, d))
        n = total[:, :, -1:]
        books = books.moved(np.where(n > 0, total[:, :, :-1] // np.maximum(n, 1), books.entries))
        if i + 1 < p.rounds:
            state = cut(_again(state, books, width), "codes")
    return state, books, width


def compress(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """Codes of all vectors: vec_id, code, error, label_error and codebooks_sha256.

    rows has vec_id, embedding and label; other columns are left behind,
    whatever their names. Rows whose vector is null, or holds nulls, NaN or
    infinities, go. Shorter vectors, the empty one among them, are filled with
    zeros to the longest one's length, and that to a multiple of the parts. The
    codebooks start from the smallest vec_ids (null ids last, rows of one id by
    their components); fewer vectors than entries make smaller codebooks.
    Repeated rows are coded each. An empty table gives an empty result. Whole
    numbers, their squared distances and sums must fit in a long.
    """
    state, books, width = trained(kept(rows, p), p)
    coded = cut(_coded(state, books, width), "coded")
    out = with_label_error(coded).withColumn("codebooks_sha256", F.lit(books.digest()))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql_round(i: int, p: Params, width: int) -> str:
    d = width // p.parts
    dist = lambda e: " + ".join(f"(x[{j + 1}] - {e}[{j + 1}]) * (x[{j + 1}] - {e}[{j + 1}])" for j in range(d))
    mean = ", ".join(f"CAST(floor(sum(x[{j + 1}]) / count(*)) AS BIGINT)" for j in range(d))
    return f""" a{i} AS (SELECT vec_id, part, x, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (SELECT p.vec_id, p.part, p.x, b.entry, {dist('b.c')} AS dist FROM parts p JOIN b{i} b USING (part)) GROUP BY 1, 2, 3),
 b{i + 1} AS (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT part, entry, [{mean}] AS c FROM a{i} GROUP BY 1, 2) n USING (part, entry)),"""


def sql(width: int, p: Params = Params()) -> str:
    """The rules in DuckDB for vectors of one width and unique ids."""
    d = width // p.parts
    rounds = "".join(_sql_round(i, p, width) for i in range(p.rounds + 1))
    last = p.rounds
    return f"""WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({p.scale} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
 parts AS (SELECT vec_id, part, v[part * {d} + 1 : part * {d} + {d}] AS x FROM whole, range({p.parts}) r(part)),
 b0 AS (SELECT part, entry, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole) USING (vec_id) WHERE entry < {p.entries}),{rounds}
 coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{last} GROUP BY 1),
 digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN whole USING (vec_id), digest"""
