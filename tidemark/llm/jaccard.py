"""N-gram Jaccard join by partitioning the universe of shingles (operator 7).

Documents are sets of distinct word shingles. Two sets whose Jaccard likeness
is at least p / 100 and whose larger one has at most hi members differ in at
most H = 2 hi (100 - p) / (100 + p) members. Hash values are cut into H + 1
segments by size band. A set may compare segment i with t = 0 (equal), t = 1
(equal after one deletion on either side) or not at all (t = -1): if the t + 1
add up to H + 1, any set within distance H agrees on some segment (pigeonhole).
Every set indexes all segments of its band and of the band above, and for the
first two also what is left after each single deletion. It probes these two with
t = 1, which allows it to leave out two others, and each segment beyond H + 1
allows one more: those of the highest cost. Costs come from the index: first all
signatures are counted, and a set leaves out segments whose signatures more than
FEW rows have, then small ones. There are about as many segments beyond H + 1 as
a set is likely to have that hold one shingle or none.

Sets that share a signature which one of them probes are candidates. Each set has
an odd sketch, the parities of its shingles in SKETCH cells; two sets differ in at
least as many members as their sketches in bits, so most candidates need no look
at the shingles. The others are verified exactly on their shingles. Sets with
equal shingles form a class first, so copies are never compared. In a bucket all
classes are first compared with one hub; buckets whose classes are then in one
component need no more. Of the others, those of few classes have all pairs between
different components compared. In larger ones a candidate must also share one of
the rarest shingles, as any two like sets do, so no bucket is multiplied out.
Pairs left out are all within one component, or cannot be alike, so the
components are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, short_batches, text_only, unused
from tidemark.llm.graph import components
from tidemark.llm.textvec import Block, blocks, distinct, grams, mix, row_numbers

#: Segments that are indexed with their one-deletion neighbourhoods.
WITH_DELETIONS = 2
#: In buckets of at most so many classes all pairs are compared; in larger ones they must share a rare shingle.
FEW = 16
#: Bits of a filter of ids at most (16 MB); a fuller filter lets more through to the exact join.
FILTER_BITS = 1 << 27
#: Cells of an odd sketch, and its 64-bit words.
SKETCH = 1024
WORDS = tuple(f"p{i}" for i in range(SKETCH // 64))
#: Counters by which shingles are ordered; any order gives the same links, a good one fewer candidates.
COUNTERS = 1 << 18
_SEG, _BAND, _ITEM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Params:
    """Words in a shingle, and the least likeness in percent."""

    words: int = 3
    percent: int = 90


def sets(b: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles; a row of fewer than k words has its whole sequence as one."""
    row = row_numbers(b)
    if len(row) >= k:
        g, inside = grams(b.hash, k), row[: len(row) - k + 1] == row[k - 1 :]
        r, h = row[: len(g)][inside], g[inside]
    else:
        r, h = row[:0], b.hash[:0]
    n = np.diff(b.first)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        whole = [mix(grams(b.hash[b.first[i] : b.first[i + 1]], k_) + _SEG * np.array([k_], np.uint64))[0] for i, k_ in zip(few, n[few].tolist(), strict=True)]
        r, h = np.concatenate((r, few)), np.concatenate((h, np.array(whole, np.uint64)))
        order = np.argsort(r, kind="stable")
        r, h = r[order], h[order]
    return distinct(r, h)


def class_ids(r: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its shingles and a 63-bit hash of the set."""
    n = np.bincount(r, minlength=rows)
    c = np.zeros(rows, np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        at = np.concatenate(([0], np.cumsum(n[some])[:-1]))
        c[some] = np.add.reduceat(mix(h ^ _ITEM), at)
    return n, mix(c + n.astype(np.uint64)) >> np.uint64(1)


def bands(top: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of the size bands up to top and one beyond, and the most that two sets may differ in each.

    A band's ends are in the ratio of the likeness, so a set's partners are in its
    own band or a neighbouring one.
    """
    ends, low = [], 1
    while not ends or ends[-1] < top or len(ends) < 2 or ends[-2] < top:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    hi = np.array(ends, np.int64)
    return hi, 2 * hi * (100 - percent) // (100 + percent)


def spare(most: np.ndarray, percent: int) -> np.ndarray:
    """How many segments there are beyond H + 1, by H: the share of segments that hold one shingle or none."""
    mean = (100 + percent) / (2 * (100 - percent)) if percent < 100 else 50
    return ((most + 1) * (1.4 * np.exp(-mean) * (1 + mean))).astype(np.int64)


def signatures(r: np.ndarray, h: np.ndarray, n: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, signature (63 bits) and whether it probes, of the sets (r, h) in sorted order with n members each.

    frequent: a filter of signatures that many sets have, which cost most.
    """
    rows = len(n)
    hi, most = bands(int(n.max(initial=1)), percent)
    band = np.searchsorted(hi, n)
    item = mix(h + _ITEM)
    for above in (0, 1):
        b = band + above
        extra = spare(most[b], percent)
        m = np.where((n > 0) & (most[b] > 0), most[b] + 1 + extra, 0)
        if above:
            m[n * 100 // percent <= hi[band]] = 0  # no partner is that large
        base = np.cumsum(m) - m
        if not m.sum():
            continue
        used = m[r] > 0
        ru, hu, iu = r[used], h[used], item[used]
        free = np.minimum(WITH_DELETIONS, m - 1)
        # segments with deletions are twice as wide, so that what one deletion leaves is rarely shared
        unit = (((hu >> np.uint64(32)) * (m + free)[ru].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        cell = base[ru] + np.where(unit < 2 * free[ru], unit // 2, unit - free[ru])
        size = np.bincount(cell, minlength=int(m.sum()))
        full = np.flatnonzero(size)
        total = np.zeros(len(size), np.uint64)
        total[full] = np.add.reduceat(iu, np.concatenate(([0], np.cumsum(size[full])[:-1])))
        cell_row = np.repeat(np.arange(rows), m)
        cell_seg = np.arange(len(size)) - base[cell_row]
        tag = cell_seg.astype(np.uint64) * _SEG + (b[cell_row].astype(np.uint64) + np.uint64(1)) * _BAND
        near = cell_seg < free[cell_row]
        own = mix(total + tag) >> np.uint64(1)
        probe = np.ones(len(size), bool)
        if above:
            probe[:] = False  # the larger of two sets probes
        else:
            cheap = size if frequent is None else np.where(in_filter(own, frequent), size, size + (1 << 30))
            order = np.lexsort((cheap + (near * (1 << 40)), cell_row))
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - base[cell_row[order]]
            probe = near | (rank >= (free + extra)[cell_row])
        yield cell_row, own, probe
        left = near[cell]
        at = cell[left]
        yield cell_row[at], mix(total[at] - iu[left] + tag[at]) >> np.uint64(1), probe[at]


def sketches(r: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """The odd sketch of each row's set: bit i is the parity of the members in cell i."""
    cell, count = np.unique((r.astype(np.int64) * SKETCH) | (mix(h ^ _BAND) >> np.uint64(54)).astype(np.int64), return_counts=True)
    cell = cell[count & 1 == 1]
    out = np.zeros(rows * len(WORDS), np.uint64)
    np.add.at(out, cell >> 6, np.uint64(1) << (cell & 63).astype(np.uint64))  # cells are distinct
    return out.reshape(rows, -1)


def describe(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n shingles, class and odd sketch of every document; the class is null where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                r, h = sets(b, p.words)
                n, c = class_ids(r, h, b.hi - b.lo)
                odd = sketches(r, h, b.hi - b.lo).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[b.lo : b.hi], pa.array(n, pa.int64()), pa.array(c.view(np.int64), mask=n == 0), *(pa.array(np.ascontiguousarray(x)) for x in odd.T)], names=["doc_id", "n", "c", *WORDS])

    return docs.mapInArrow(run, "doc_id long, n long, c long, " + ", ".join(f"{w} long" for w in WORDS))


def text_class(p: Params) -> Callable[[Column], Column]:
    """A column function: the class that describe() gives a text."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for b in blocks(texts):
            n, c = class_ids(*sets(b, p.words), b.hi - b.lo)
            out.append(pa.array(c.view(np.int64), mask=n == 0))
        return pa.concat_arrays(out) if out else pa.array([], pa.int64())

    return run


def index(docs: DataFrame, p: Params, wanted: np.ndarray | None = None, frequent: np.ndarray | None = None) -> DataFrame:
    """s (signature) and v (class; as its complement, which is negative, where the set does not probe).

    wanted: a filter of signatures that few others pass. frequent: of those that many sets have.
    """
    shared = docs.sparkSession.sparkContext.broadcast((wanted, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, frequent = shared.value
        seen: set[int] = set()  # copies within the task need not be indexed again
        for batch in batches:
            for b in blocks(batch.column(1)):
                r, h = sets(b, p.words)
                n, c = class_ids(r, h, b.hi - b.lo)
                c = c.view(np.int64)
                fresh = unseen(c, n > 0, seen)
                keep = fresh[r]
                for row, s, probe in signatures(r[keep], h[keep], np.where(fresh, n, 0), p.percent, frequent):
                    if wanted is not None:
                        hit = in_filter(s, wanted)
                        row, s, probe = row[hit], s[hit], probe[hit]
                    v = c[row]
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.where(probe, v, ~v))], names=["s", "v"])

    return docs.select("doc_id", "text").mapInArrow(run, "s long, v long")


def unseen(c: np.ndarray, ask: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which of the asked classes are not in seen, which is added to; it forgets all when it holds a million."""
    out = np.zeros(len(c), bool)
    for i in np.flatnonzero(ask).tolist():
        x = int(c[i])
        if x not in seen:
            seen.add(x)
            out[i] = True
    if len(seen) > 1_000_000:
        seen.clear()
    return out


def class_of(v: Column) -> Column:
    return F.when(v < 0, F.bitwise_not(v)).otherwise(v)


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter with two places for each id, which is a hash already; its size follows their number up to a fixed bound."""
    n = ids.count()
    bits = min(FILTER_BITS, 1 << max(10, (16 * n).bit_length()))
    places = ids.select(F.explode(F.array(F.col(column).bitwiseAND(bits - 1), F.shiftright(column, 32).bitwiseAND(bits - 1))).alias("h"))
    words = places.groupBy(F.shiftright("h", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def in_filter(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bitmap) * 64 - 1)
    a, b = h & mask, h >> np.uint64(32) & mask
    return (bitmap[a >> np.uint64(6)] >> (a & np.uint64(63)) & bitmap[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)


def sets_of(docs: DataFrame, wanted: DataFrame, p: Params, schema: str, rows: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """What rows() makes of the class, the size and the joined shingles of some sets: all wanted (c) ones, and few others.

    Copies of a set within a task come once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in blocks(batch.column(1)):
                r, h = sets(b, p.words)
                n, c = class_ids(r, h, b.hi - b.lo)
                take = unseen(c.view(np.int64), (n > 0) & in_filter(c, shared.value), seen)
                if take.any():
                    yield rows(c[take].view(np.int64), n[take], h[take[r]])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """c and its shingles for each wanted class."""

    def rows(c: np.ndarray, n: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))], names=["c", "items"])

    return sets_of(docs, wanted, p, "c long, items array<long>", rows).join(wanted, "c", "left_semi").dropDuplicates(["c"])


def can_be_alike(pairs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and sketches do not rule out that they are as like as asked."""
    a, b = (classes.select(F.col("c").alias(x), F.col("size").alias(f"{x}_size"), *(F.col(w).alias(f"{x}_{w}") for w in WORDS)) for x in "ab")
    apart = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in WORDS[1:]), F.bit_count(F.col(f"a_{WORDS[0]}").bitwiseXOR(F.col(f"b_{WORDS[0]}"))))
    sizes = F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * p.percent
    return pairs.join(a, "a").join(b, "b").where(sizes & (apart * (100 + p.percent) <= (F.col("a_size") + F.col("b_size")) * (100 - p.percent))).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of classes that are as like as asked, by their shingles."""
    items = cut(shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), p), "jaccard-sets")
    a = items.select(F.col("c").alias("a"), F.col("items").alias("x"))
    b = items.select(F.col("c").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    return pairs.join(a, "a").join(b, "b").where(both * 100 >= union * p.percent).select("a", "b")


def link_classes(docs: DataFrame, classes: DataFrame, p: Params) -> DataFrame | None:
    """node and root for each class (c, n documents, size and sketch) that is linked with another one; None if there is no candidate.

    A bucket's hub is the class of most documents: what near copies were made from often is.
    """
    counts = cut(index(docs, p).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-signatures")
    if counts.isEmpty():
        return None
    rows = cut(index(docs, p, id_filter(counts, "s"), id_filter(counts.where(F.col("n") > FEW), "s")), "jaccard-index")
    # the highest value probes if any does
    buckets = rows.groupBy("s").agg(F.min("v").alias("low"), F.max("v").alias("high")).where((F.col("high") >= 0) & (class_of(F.col("low")) != F.col("high")))
    members = cut(rows.join(buckets, "s").groupBy("s", class_of(F.col("v")).alias("c")).agg((F.max("v") >= 0).alias("probes")), "jaccard-buckets")

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    hubs = members.join(classes.select("c", "n"), "c").groupBy("s").agg(F.max_by(F.struct("c", "probes"), F.struct("n", F.xxhash64("c"))).alias("hub"))
    tried = ordered(members.join(hubs, "s").where("probes or hub.probes").select(F.col("c").alias("a"), F.col("hub.c").alias("b")))
    tried = cut(can_be_alike(tried, classes, p), "jaccard-pairs")
    links = cut(verified(tried, docs, p), "jaccard-links")
    roots = components(links, "jaccard-components")
    at = members.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    mixed = at.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low != high")
    members = cut(at.join(mixed.select("s", "n"), "s"), "jaccard-buckets")
    one = members.where(F.col("n") <= FEW).select("s", F.col("c").alias("a"), F.col("root").alias("ra"), F.col("probes").alias("pa"))
    more = one.join(one.select("s", F.col("a").alias("b"), F.col("ra").alias("rb"), F.col("pa").alias("pb")), "s").where("ra != rb and a > b and (pa or pb)").select("a", "b")
    large = members.where(F.col("n") > FEW).select("c", "root").distinct()
    if not large.isEmpty():
        more = more.unionByName(rare_pairs(docs, cut(large, "jaccard-large"), p))
    fresh = cut(can_be_alike(ordered(more), classes, p).join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    if fresh.isEmpty():
        return roots
    return components(links.unionByName(cut(verified(fresh, docs, p), "jaccard-links")), "jaccard-components")


def shingle_order(docs: DataFrame, wanted: DataFrame, p: Params) -> np.ndarray:
    """How many shingles of the wanted classes, copies in other tasks among them, fall to each of COUNTERS counters."""

    def rows(c: np.ndarray, n: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        cell, count = np.unique((h & np.uint64(COUNTERS - 1)).astype(np.int32), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count, pa.int64())], names=["cell", "n"])

    found = sets_of(docs, wanted, p, "cell int, n long", rows).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def rare_pairs(docs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of classes (c, root) of different roots that share one of their rarest shingles where like sets must.

    If two sets of m and n shingles share at least k, the first m - k + 1 of one
    and the first n - k + 1 of the other, in any order common to all, have one in
    common; k follows from the sizes, and the places of the common shingle bound
    what the sets can share.
    """
    t = p.percent
    shared = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, classes, p))

    def rows(c: np.ndarray, n: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        which = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, shared.value[(h & np.uint64(COUNTERS - 1)).astype(np.int64)], which))
        at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        first = at < (n + (-n * t // 100) + 1)[which]
        return pa.RecordBatch.from_arrays([pa.array(c[which[first]]), pa.array(n[which[first]], pa.int64()), pa.array(at[first], pa.int32()), pa.array(h[order][first].view(np.int64))], names=["c", "n", "at", "g"])

    up = lambda x, by: F.floor((x + (by - 1)) / by)
    prefix = sets_of(docs, classes, p, "c long, n long, at int, g long", rows).join(classes, "c").distinct()
    prefix = cut(prefix, "jaccard-prefixes")
    small = prefix.where(F.col("at") <= F.col("n") - up(F.col("n") * (2 * t), 100 + t)).select("g", F.col("c").alias("a"), F.col("root").alias("ra"), F.col("n").alias("m"), F.col("at").alias("i"))
    large = prefix.select("g", F.col("c").alias("b"), F.col("root").alias("rb"), "n", F.col("at").alias("j"))
    sizes = (F.col("m") * 100 >= F.col("n") * t) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") < F.col("b"))))
    # the common shingle and what stands behind it in both
    room = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) * (100 + t) >= (F.col("m") + F.col("n")) * t
    return small.join(large, "g").where(sizes & room & (F.col("ra") != F.col("rb"))).select("a", "b")


def join(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Link documents by the Jaccard likeness of their shingles.

    Returns doc_id, n_shingles and component_id, the smallest doc_id reachable by
    links. Documents with the same set of shingles are linked; texts without
    words, null among them, are linked with nothing. Rows sharing a doc_id are
    rows of their own. An empty table gives an empty result; other columns are
    left behind. Shingles and sets are compared by 64-bit hashes.
    """
    return rows_linked(docs, p).drop("c")


def rows_linked(docs: DataFrame, p: Params) -> DataFrame:
    """What join() returns, and the class of the row's set of shingles."""
    short_batches(docs.sparkSession)
    docs = text_only(docs)
    members = cut(describe(docs, p), "jaccard-documents")
    classes = cut(members.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"), F.min("n").alias("size"), *(F.min(w).alias(w) for w in WORDS)), "jaccard-classes")
    roots = link_classes(docs, classes, p)
    if roots is not None:
        roots = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", "low", F.coalesce("root", "c").alias("root"))
        lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
        classes = roots.join(lowest, "root").select("c", "component_id")
    else:
        classes = classes.select("c", F.col("low").alias("component_id"))
    out = members.join(classes, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "c")


def one_of_each(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents, of each group of linked ones that of the smallest doc_id; columns stay as they are, whatever their names.

    Documents linked with nothing stay, null and empty texts among them; an empty table stays empty. Rows that share the doc_id that stays all
    stay if their texts differ; of equal ones one stays. Of rows that share
    another doc_id only those go whose own text is linked.
    """
    found = cut(rows_linked(docs, p), "jaccard-kept")
    id_, class_, gone_id, gone_class, again_id = unused(docs, "id", "class", "gone_id", "gone_class", "again_id")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(gone_id), F.col("c").alias(gone_class)).distinct()
    again = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again_id))
    rows = docs.withColumn(id_, F.col("doc_id").cast("long"))
    own = F.col(id_).eqNullSafe(F.col(gone_id))
    if again.isEmpty():
        return rows.join(gone, own, "left_anti").drop(id_)
    same = F.col(id_).eqNullSafe(F.col(again_id))
    shared = rows.join(again, same, "left_semi").dropDuplicates([id_, "text"]).withColumn(class_, text_class(p)(F.col("text").cast("string")))
    alone = rows.join(again, same, "left_anti").join(gone, own, "left_anti")
    return alone.unionByName(shared.join(gone, own & (F.col(class_) == F.col(gone_class)), "left_anti").drop(class_)).drop(id_)
