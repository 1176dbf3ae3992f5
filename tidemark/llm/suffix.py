"""Repeated passages by sparse suffix arrays (operator 5).

Of all suffixes of the texts (in words, A-Z lower-cased) only those are kept that
begin at content-selected positions: the minimisers of windows of WINDOW
consecutive K-word grams. Two passages of K + WINDOW - 1 equal words share such
a position. Suffixes whose first K words occur once are dropped; the others are
dealt by these words. With the words before and after its gram, a suffix lies in
WINDOW runs of min_words words, and suffixes are sorted by each of these runs:
those that have one in common share a whole passage. Beyond the runs the next
selected position takes over, and the union of the runs is the whole passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, partitions, short_batches, text_only, unused
from tidemark.llm.textvec import Block, blocks, grams, mix, row_numbers

#: Bits of the filter of repeated grams for each of them, and at most (128 MB); a fuller filter lets suffixes through that then have no neighbour.
BITS_EACH, FILTER_BITS = 32, 1 << 30
#: Suffixes that are sorted together; a group of equal grams is not parted.
CHUNK = 20_000
_NONE = -(1 << 63)


@dataclass(frozen=True)
class Params:
    """The least length of a repeated passage in words; a group of more suffixes than hot is dealt over tasks by its runs."""

    min_words: int = 50
    hot: int = 50_000

    @property
    def gram(self) -> int:
        return self.min_words // 2

    @property
    def window(self) -> int:
        return self.min_words - self.gram + 1


def _slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each run of w values, by doubling."""
    done, out = 1, x
    while done * 2 <= w:
        out = op(out[:-done], out[done:])
        done *= 2
    return op(out[: len(out) - (w - done)], out[w - done :]) if done < w else out


def selected(b: Block, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of a block where kept suffixes begin, and the hashes of their grams."""
    k, w = p.gram, p.window
    if len(b.hash) < k + w - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = row_numbers(b)
    g = grams(b.hash, k)
    low = _slide(g, w, np.minimum)
    low[row[: len(low)] != row[k + w - 2 :]] = 0  # windows that cross documents select nothing
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((pad, low, pad)), w, np.maximum) == g)
    return at, g[at]


def suffixes(docs: DataFrame, p: Params) -> DataFrame:
    """gram and doc_id of every kept suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for b in blocks(batch.column(1)):
                at, g = selected(b, p)
                if len(at):
                    rows = np.searchsorted(b.first, at, "right") - 1 + b.lo
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), ids.take(pa.array(rows))], names=["gram", "doc_id"])

    return docs.mapInArrow(run, "gram long, doc_id long")


def repeated_filter(grams_: DataFrame, n: int) -> np.ndarray:
    bits = min(FILTER_BITS, 1 << max(10, (BITS_EACH * n).bit_length()))
    words = grams_.groupBy(F.shiftright(F.col("gram").bitwiseAND(bits - 1), 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(gram & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def with_context(docs: DataFrame, bitmap: np.ndarray, p: Params) -> DataFrame:
    """gram, doc_id, pos and context of the suffixes that pass the filter.

    The context is 32-bit word hashes: those after the gram, then those before
    it, the nearest first; 0 stands beyond the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    k = p.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask = np.uint64(len(bits) * 64 - 1)
        steps = np.arange(p.min_words - k)
        for batch in batches:
            ids = batch.column(0)
            for b in blocks(batch.column(1)):
                at, g = selected(b, p)
                x = g & mask
                hit = (bits[x >> np.uint64(6)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)
                at, g = at[hit], g[hit]
                if not len(at):
                    continue
                row = np.searchsorted(b.first, at, "right") - 1
                short = (b.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                after, before = at[:, None] + k + steps, at[:, None] - 1 - steps
                right = np.where(after < b.first[row + 1][:, None], short[np.minimum(after, len(short) - 1)], 0)
                left = np.where(before >= b.first[row][:, None], short[np.maximum(before, 0)], 0)
                context = np.ascontiguousarray(np.concatenate((right, left), axis=1), ">u4")
                data = pa.py_buffer(context.tobytes())
                width = context.shape[1] * 4
                ends = pa.py_buffer((np.arange(len(at) + 1) * width).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), ids.take(pa.array(row + b.lo)), pa.array((at - b.first[row]).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(at), [None, ends, data])],
                    names=["gram", "doc_id", "pos", "context"],
                )

    return docs.mapInArrow(run, "gram long, doc_id long, pos int, context binary")


def shared_runs(gram: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For r = 0, 1, ... up to the words on either side: which suffixes have r words after the gram and the others of the run before it, and the hashes of the runs.

    words holds what follows each gram, then what precedes it.
    """
    n = words.shape[1] // 2
    c = np.uint64(0xD6E8FEB86659FD93)
    right, left = [gram.astype(np.int64).view(np.uint64)], [np.zeros(len(gram), np.uint64)]
    for j in range(n):
        right.append(mix(right[-1] * c + words[:, j]))
        left.append(mix(left[-1] * c + words[:, n + j]))
    for r in range(n + 1):
        there = np.ones(len(gram), bool)
        if r:
            there &= words[:, r - 1] != 0
        if r < n:
            there &= words[:, 2 * n - r - 1] != 0
        yield there, mix(right[r] * c + left[n - r])


def extend(gram: np.ndarray, doc: np.ndarray, words: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For each suffix, the least and the greatest r of the runs that an earlier document has, and of those that a later one has; -1: there is none."""
    n = len(gram)
    out = tuple((np.full(n, -1), np.full(n, -1)) for _ in range(2))
    for r, (there, run) in enumerate(shared_runs(gram, words)):
        at = np.flatnonzero(there)
        if len(at) < 2:
            continue
        at = at[np.lexsort((doc[at], run[at]))]
        new = np.concatenate(([True], run[at[1:]] != run[at[:-1]]))
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(at)])) - 1
        d = doc[at]
        for (low, high), hit in zip(out, (d[first][group] < d, d[last][group] > d), strict=True):
            i = at[hit]
            low[i] = np.where(low[i] < 0, r, low[i])
            high[i] = r
    return out


def spans(found: DataFrame, p: Params) -> DataFrame:
    """doc_id and the span start..end of each suffix's runs that another document has; later is true if an earlier document has them."""
    k, side = p.gram, p.min_words - p.gram

    def work(gram: np.ndarray, doc: np.ndarray, pos: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        for (low, high), flag in zip(extend(gram, doc, words), (True, False), strict=True):
            keep = low >= 0
            if keep.any():
                ids = doc[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == _NONE), pa.array(pos[keep] - side + low[keep], pa.int64()), pa.array(pos[keep] + k + high[keep], pa.int64()), pa.array([flag] * int(keep.sum()))], names=["doc_id", "start", "end", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def arrays(upto: int | None) -> tuple:
            nonlocal held, size
            gram, doc, pos, words = (np.concatenate(x) for x in zip(*held, strict=True))
            stop = len(gram) if upto is None else int(np.flatnonzero(gram != gram[-1])[-1] + 1) if (gram != gram[-1]).any() else 0
            held = [(gram[stop:], doc[stop:], pos[stop:], words[stop:])]
            size = len(gram) - stop
            return gram[:stop], doc[:stop], pos[:stop], words[:stop]

        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column(1).fill_null(_NONE).to_numpy()
            words = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u4").reshape(batch.num_rows, 2 * side)
            held.append((batch.column(0).to_numpy(), doc, batch.column(2).to_numpy().astype(np.int64), words))
            size += batch.num_rows
            if size >= CHUNK:
                part = arrays(1)
                if len(part[0]):
                    yield from work(*part)
        if held and size:
            yield from work(*arrays(None))

    dealt = found.repartition(partitions(found.sparkSession), "gram").sortWithinPartitions("gram")
    return dealt.select("gram", "doc_id", "pos", "context").mapInArrow(run, "doc_id long, start long, end long, later boolean")


def hot_spans(found: DataFrame, heavy: int, p: Params) -> DataFrame:
    """The spans of suffixes whose grams are too frequent for one task: the same as spans() finds.

    The runs of min_words words are dealt instead of the grams, and of each only
    the first and the last document and the count are kept. A run of more than
    heavy suffixes is sent to where these are; there are few such runs.
    """
    k, side = p.gram, p.min_words - p.gram
    found = cut(found.select("gram", "doc_id", "pos", "context"), "hot-suffixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u4").reshape(batch.num_rows, 2 * side)
            for r, (there, h) in enumerate(shared_runs(batch.column(0).to_numpy(), words)):
                at = pa.array(np.flatnonzero(there))
                yield pa.RecordBatch.from_arrays([pa.array(h[there].view(np.int64)), batch.column(1).take(at), batch.column(2).take(at), pa.array(np.full(len(at), r, np.int32))], names=["run", "doc_id", "pos", "r"])

    rows = found.mapInArrow(run, "run long, doc_id long, pos int, r int")
    key = F.coalesce("doc_id", F.lit(_NONE))
    runs = cut(rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).where("first != last"), "hot-runs")
    often = F.broadcast(runs.where(F.col("n") > heavy))
    each = rows.join(often, "run").unionByName(rows.join(often.select("run"), "run", "left_anti").join(runs.where(F.col("n") <= heavy), "run"))
    of = lambda cond, later: F.struct(F.min(F.when(cond, F.col("r"))).alias("low"), F.max(F.when(cond, F.col("r"))).alias("high"), F.lit(later).alias("later"))
    both = each.groupBy("doc_id", "pos").agg(F.array(of(F.col("first") < key, True), of(F.col("last") > key, False)).alias("x"))
    out = both.select("doc_id", "pos", F.inline("x")).where("low IS NOT NULL")
    return out.select("doc_id", (F.col("pos") - side + F.col("low")).cast("long").alias("start"), (F.col("pos") + k + F.col("high")).cast("long").alias("end"), "later")


def _merged(list_: str) -> Column:
    """Sorted spans joined where they touch or overlap."""
    kind = "array<struct<start:bigint,end:bigint>>"
    return F.aggregate(
        F.array_sort(list_),
        F.array().cast(kind),
        lambda acc, x: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["end"] < x["start"]), F.concat(acc, F.array(x))).otherwise(
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))))
        ),
    )


def repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The passages of at least min_words words that stand in more than one document.

    Returns, for each document that has any, doc_id, passages (array of word
    ranges start..end), copied (those that a document of smaller doc_id has),
    n_words and n_copied. Null and short texts have none; passages repeated
    within one document alone are not reported. doc_id is the key: rows sharing
    it count as one document, null ids as the smallest. An empty table gives an
    empty result; other columns are left behind.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = text_only(docs)
    counted = suffixes(docs, p).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("doc_id", F.lit(_NONE))).alias("first"), F.max(F.coalesce("doc_id", F.lit(_NONE))).alias("last"))
    grams_ = cut(counted.where("first != last").select("gram", "n"), "repeated-grams")
    size = grams_.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    found = with_context(docs, repeated_filter(grams_, size["n"]), p)
    heavy = max(p.hot, size["rows"] // (16 * partitions(spark)))
    # at most 16 grams a partition can have more rows than this
    hot = [r["gram"] for r in grams_.where(F.col("n") > heavy).select("gram").collect()]
    if hot:
        each = spans(found.where(~F.col("gram").isin(hot)), p).unionByName(hot_spans(found.where(F.col("gram").isin(hot)), heavy, p))
    else:
        each = spans(found, p)
    lists = each.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("all"), F.collect_list(F.when(F.col("later"), F.struct("start", "end"))).alias("some"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    long_enough = lambda c: F.filter(c, lambda x: x["end"] - x["start"] >= p.min_words)
    out = lists.select("doc_id", long_enough(_merged("all")).alias("passages"), long_enough(_merged("some")).alias("copied")).where(F.size("passages") > 0)
    return out.select("doc_id", "passages", "copied", total("passages").alias("n_words"), total("copied").alias("n_copied"))


def without_copies(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents without passages that an earlier one has; a document of which no word is left goes.

    Columns stay as they are, but text and n_chars where words were cut: a cut
    goes from the passage's first word to the next word that stays. Null and
    short texts stay as they are, an empty table stays empty, and other columns
    may have any names. Rows of different texts that share a doc_id stay whole,
    as a place in one text says nothing about the other.
    """
    copy_of, ranges = unused(docs, "copy_of", "ranges")
    copies = repeats(docs, p).where("n_copied > 0").select(F.col("doc_id").alias(copy_of), F.col("copied").alias(ranges))
    schema = docs.schema
    h = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    unlike = docs.select(F.col("doc_id").cast("long").alias("unlike"), h.alias("h")).groupBy("unlike").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low != high")
    copies = copies.join(unlike, F.col(copy_of).eqNullSafe(F.col("unlike")), "left_anti")
    joined = docs.join(copies, docs["doc_id"].cast("long").eqNullSafe(F.col(copy_of)), "left").drop(copy_of)
    text_at, chars_at = schema.names.index("text"), schema.names.index("n_chars") if "n_chars" in schema.names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(text_at).to_pylist(), [True] * batch.num_rows
            chars = batch.column(chars_at).to_pylist() if chars_at is not None else []
            for i, gone in enumerate(batch.column(len(schema)).to_pylist()):
                if not gone:
                    continue
                b = next(blocks(pa.array([texts[i]], pa.large_string())))
                raw, left, at = texts[i].encode(), [], 0
                for s in gone:
                    left.append(raw[at : b.start[s["start"]]])
                    at = int(b.start[s["end"]]) if s["end"] < len(b.start) else len(raw)
                texts[i] = b"".join([*left, raw[at:]]).decode()
                keep[i] = bool(texts[i].strip())
                if chars:
                    chars[i] = len(texts[i])
            columns = list(batch.columns[: len(schema)])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if chars:
                columns[chars_at] = pa.array(chars, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(keep))

    return joined.mapInArrow(run, schema)
