"""Exact top-k inner products by a dual-tree search over cover trees (operator 13).

One tree indexes queries and data together. Its top level is a net of centres
taken from a bounded sample; every row belongs to its nearest centre, and each
cell's rows are dealt by chance into blocks of bounded size, in which the lower
levels are built. A pair of nodes, one of queries and one of data, cannot hold a
product above <p, q> + r_q |p| + r_p |q| + r_p r_q for their centres and covering
radii; it is pruned when that is below the worst kth score of the node's queries.
Pairs of cells and pairs of blocks are pruned before any row is shipped, pairs of
inner nodes within the task that has both blocks, and pairs of leaves are one
matrix product in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.codebooks import padded, usable
from tidemark.llm.common import bounded_batches, cut

#: Nothing scores as low; the threshold of a query that has too few candidates yet.
NONE = -(1 << 62)
#: Blocks of a cell that are joined under one key.
GROUP = 64
#: Children of a node at most.
FANOUT = 16


@dataclass(frozen=True)
class Params:
    """k results a query; every-th ids are queries; components become floor(scale x).

    sample rows are drawn to choose at most cells centres, one for block rows; a
    block has about block rows or block_queries queries, a leaf at most leaf rows.
    """

    k: int = 10
    every: int = 100
    scale: int = 1024
    sample: int = 4096
    cells: int = 512
    block: int = 2048
    block_queries: int = 256
    leaf: int = 64


@dataclass
class Node:
    """Rows of a block from lo to hi that lie within radius of a centre."""

    lo: int
    hi: int
    centre: np.ndarray
    norm: float
    radius: float
    children: list[Node]


class Tree:
    """A cover tree over rows: children's centres are rows of the node, farther apart than half its radius, and cover it within that.

    Where half the radius would take more than FANOUT centres, as in many
    dimensions, that many of the farthest apart are taken, and cover it within
    a larger radius, which every node has as it is.
    Rows are put in the order of the leaves, so that every node is a slice.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, leaf: int) -> None:
        self.leaf = leaf
        order: list[np.ndarray] = []
        x = v.astype(float)
        centre = x.mean(0) if len(x) else np.zeros(v.shape[1])
        near = np.sqrt(((x - centre) ** 2).sum(1))
        self.root = self._node(x, np.arange(len(x)), centre, near, 0, order)
        self.at = np.concatenate(order)
        self.ids, self.v, self.x = ids[self.at], v[self.at], x[self.at]
        self.most = float(np.abs(x).max(initial=0.0))

    def _node(self, x: np.ndarray, rows: np.ndarray, centre: np.ndarray, near: np.ndarray, lo: int, order: list[np.ndarray]) -> Node:
        radius = float(near.max(initial=0.0))
        node = Node(lo, lo + len(rows), centre, float(np.sqrt((centre**2).sum())), radius * (1 + 1e-9), [])
        if len(rows) <= self.leaf or radius == 0:
            order.append(rows)
            return node
        mine = x[rows]
        best, owner, centres = np.full(len(rows), np.inf), np.zeros(len(rows), int), []
        nxt = int(near.argmin())
        while True:  # the farthest row from all centres so far is the next one
            d = np.sqrt(((mine - mine[nxt]) ** 2).sum(1))
            owner[d < best] = len(centres)
            best = np.minimum(best, d)
            centres.append(nxt)
            nxt = int(best.argmax())
            if best[nxt] <= radius / 2 or len(centres) == FANOUT:
                break
        for i, c in enumerate(centres):
            own = owner == i
            node.children.append(self._node(x, rows[own], mine[c], best[own], lo, order))
            lo += int(own.sum())
        return node


@dataclass
class Best:
    """The k best so far of each query of a tree, best first: scores and ids."""

    score: np.ndarray
    id: np.ndarray

    @classmethod
    def none(cls, queries: int, k: int) -> Best:
        return cls(np.full((queries, k), NONE, np.int64), np.full((queries, k), np.iinfo(np.int64).max, np.int64))

    def add(self, lo: int, hi: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores (hi - lo, n) of candidates with ids (n), NONE where there is no candidate."""
        k = self.score.shape[1]
        some = np.flatnonzero((score >= self.score[lo:hi, -1:]).any(1))
        for q in some:
            new = score[q] >= self.score[lo + q, -1]
            s, i = np.concatenate((self.score[lo + q], score[q][new])), np.concatenate((self.id[lo + q], ids[new]))
            at = np.lexsort((i, -s))[:k]
            self.score[lo + q], self.id[lo + q] = s[at], i[at]


def products(q: Tree, a: Node, d: Tree, b: Node) -> np.ndarray:
    """Inner products of two nodes' rows, exact: in doubles where no partial sum can leave their exact range."""
    if q.most * d.most * q.v.shape[1] < 2**53:
        return (q.x[a.lo : a.hi] @ d.x[b.lo : b.hi].T).astype(np.int64)
    return q.v[a.lo : a.hi] @ d.v[b.lo : b.hi].T


def bound(q: Node, p: Node) -> float:
    """No row of p has a larger product with a query of q."""
    b = float(q.centre @ p.centre) + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius
    return b + 1e-9 * (q.norm + q.radius) * (p.norm + p.radius) + 1e-6


def search(queries: Tree, data: Tree, best: Best, least: np.ndarray) -> int:
    """Bring best up to the rows of data; least is what a query's kth score is known to reach. Returns the number of products made.

    Of a pair the node with the larger radius is split, and the pair of the
    larger bound comes first. A query's own id is no candidate.
    """
    made = 0
    stack = [(bound(queries.root, data.root), queries.root, data.root)]
    while stack:
        most, q, p = stack.pop()
        worst = np.maximum(best.score[q.lo : q.hi, -1], least[q.lo : q.hi]).min(initial=np.iinfo(np.int64).max)
        if q.lo == q.hi or p.lo == p.hi or most < worst:
            continue
        if not q.children and not p.children:
            score = products(queries, q, data, p)
            score[queries.ids[q.lo : q.hi, None] == data.ids[None, p.lo : p.hi]] = NONE
            best.add(q.lo, q.hi, score, data.ids[p.lo : p.hi])
            made += score.size
        elif p.children and (not q.children or p.radius >= q.radius):
            stack += sorted(((bound(q, c), q, c) for c in p.children), key=lambda x: x[0])
        else:
            stack += sorted(((bound(c, p), c, p) for c in q.children), key=lambda x: x[0])
    return made


def vectors(rows: DataFrame, p: Params) -> DataFrame:
    """vec_id and v, whole numbers, of the rows that take part."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(p.scale) * x.cast("double")))
    return rows.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def net(rows: DataFrame, n: int, width: int, p: Params) -> np.ndarray:
    """The top of the tree: centres from a random sample of at most p.sample rows; each the farthest from those before it."""
    drawn = rows.withColumn("_draw", F.rand(5)).where(F.col("_draw") < (2 * p.sample + 64) / max(n, 1))
    some = drawn.orderBy("_draw").limit(p.sample).select("v").collect()
    x = np.array([r["v"] + [0] * (width - len(r["v"])) for r in some], float).reshape(len(some), width)
    wanted = max(1, min(p.cells, n // p.block))
    at, best = 0, np.full(len(x), np.inf)
    centres = []
    while len(x) and len(centres) < wanted:
        centres.append(x[at])
        best = np.minimum(best, ((x - x[at]) ** 2).sum(1))
        at = int(best.argmax())
        if best[at] == 0:
            break
    return np.array(centres)


_ROW = "cell int, far double, vec_id bigint, v array<bigint>"
#: A block as one row: its rows, and the centre's cell and covering radius.
_BLOCK = "cell int, part int, n int, radius double, ids binary, v binary"


def _in_cells(rows: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """rows with the nearest centre and the distance from it."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            x = padded(b.column(1), width)
            y = x.astype(float)
            cell = ((c**2).sum(1) - 2 * y @ c.T).argmin(1)
            far = np.sqrt(((y - c[cell]) ** 2).sum(1)) * (1 + 1e-9)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(far), b.column(0), v], names=["cell", "far", "vec_id", "v"])

    return rows.mapInArrow(run, _ROW)


def _blocks(rows: DataFrame, sizes: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of each cell dealt by chance into blocks of about size; sizes has a row a cell."""
    parts = sizes.select("cell", F.ceil(F.col("n") / size).alias("_parts"))
    dealt = rows.join(F.broadcast(parts), "cell").withColumn("part", F.floor(F.rand(11) * F.col("_parts")).cast("int")).drop("_parts")

    def run(group: pa.Table) -> pa.Table:
        v = group.column("v").combine_chunks()
        ids = group.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = v.flatten().to_numpy().reshape(len(ids), -1)[order]
        return pa.Table.from_pydict({"cell": group.column("cell")[:1], "part": group.column("part")[:1], "n": pa.array([len(ids)], pa.int32()), "radius": pa.array([max(group.column("far").to_pylist())]), "ids": pa.array([ids[order].tobytes()], pa.binary()), "v": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())})

    return cut(dealt.groupBy("cell", "part").applyInArrow(run, _BLOCK), name)


def _searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, width: int, p: Params) -> DataFrame:
    """The k best of each query in each pair of blocks: q_cell, q_part, place (of the query in its block), query_id, vec_id, score.

    pairs has q_cell, q_part, d_cell, d_part. Queries are dealt to the data
    blocks they are paired with and follow them in order, so a task holds one
    data block and its tree, and one block of queries, at a time.
    """
    key = ["d_cell", "d_part"]
    d = data.select(F.col("cell").alias("d_cell"), F.col("part").alias("d_part"), F.lit(-1).alias("q_cell"), F.lit(-1).alias("q_part"), "ids", "v", F.lit(None).cast("array<bigint>").alias("kth"))
    d = d.join(pairs.select(*key).distinct(), key, "left_semi")
    q = pairs.join(queries.withColumnsRenamed({"cell": "q_cell", "part": "q_part"}), ["q_cell", "q_part"]).select(*d.columns)
    rows = d.unionByName(q).repartition(*key).sortWithinPartitions(*key, "q_cell", "q_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = None
        for b in batches:
            for row in b.to_pylist():
                t = Tree(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["v"], np.int64).reshape(-1, width), p.leaf)
                if row["q_cell"] < 0:
                    data = t
                    continue
                best = Best.none(len(t.ids), p.k)
                least = np.full(len(t.ids), NONE, np.int64) if row["kth"] is None else np.array(row["kth"], np.int64)[t.at]
                search(t, data, best, least)
                i, j = np.nonzero((best.score > NONE) & (best.score >= least[:, None]))
                one = lambda c: pa.array(np.full(len(i), row[c]), pa.int32())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([one("q_cell"), one("q_part"), pa.array(t.at[i], pa.int32()), pa.array(t.ids[i]), pa.array(best.id[i, j]), pa.array(best.score[i, j])], names=["q_cell", "q_part", "place", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "q_cell int, q_part int, place int, query_id bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query."""
    w = Window.partitionBy("q_cell", "q_part", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def top(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """The k highest inner products of every query with all other rows: query_id, rank, vec_id, score.

    rows has vec_id and embedding; other columns are left behind, whatever their
    names. Queries are the rows whose id is divisible by p.every, candidates all
    rows of another id. Rows with a null id, and vectors that are null or hold
    nulls, NaN or infinities, take no part. Equal scores go to the smaller id.
    Shorter vectors, the empty one among them, count as filled with zeros.
    Repeated candidates take a rank each; an id with several different query
    vectors is answered for each, repeated query rows once. A query has fewer
    rows where there are fewer candidates; an empty table gives an empty result.
    Products must fit in a long.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    all_rows = vectors(rows, p)
    n, width = all_rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = width or 1
    centres = net(all_rows, n, width, p)
    if not len(centres):
        return _frame(spark, [], "query_id bigint, rank int, vec_id bigint, score bigint")
    placed = cut(_in_cells(all_rows, centres, width), "cells")
    is_query = F.pmod("vec_id", F.lit(p.every)) == 0
    asked = placed.where(is_query).dropDuplicates(["vec_id", "v"])
    asked = cut(asked, "queries")
    count = lambda x: x.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    cells, query_cells = count(placed), count(asked)
    data, queries = _blocks(placed, cells, p.block, "blocks"), _blocks(asked, query_cells, p.block_queries, "query-blocks")

    # the top level: a row a cell, of which there are at most p.cells
    radius, size = np.zeros(len(centres)), np.zeros(len(centres), int)
    for r in cells.collect():
        radius[r["cell"]], size[r["cell"]] = r["radius"], r["n"]
    own = {r["cell"]: r["radius"] for r in query_cells.collect()}
    norm = np.sqrt((centres**2).sum(1))
    inner = centres @ centres.T

    # first one block of each query cell's best cells, until there can be k candidates: their kth scores are thresholds
    one = data.groupBy("cell").agg(F.min(F.struct("part", "n")).alias("x")).select("cell", "x.part", "x.n").collect()
    firsts = {r["cell"]: (r["part"], r["n"]) for r in one}
    seeds = []
    for c in own:
        have = 0
        for d in np.argsort(-inner[c], kind="stable").tolist():
            if d in firsts and have <= p.k:
                seeds.append((c, d, firsts[d][0]))
                have += firsts[d][1]
    seed = _frame(spark, seeds, "q_cell int, d_cell int, d_part int")
    places = queries.select(F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("radius").alias("q_radius"))
    none = queries.withColumn("kth", F.lit(None).cast("array<bigint>"))
    first = _ranked(_searched(places.join(F.broadcast(seed), "q_cell"), none, data, width, p), p.k)
    kth = first.groupBy("q_cell", "q_part", "place").agg(F.when(F.count(F.lit(1)) == p.k, F.min("score")).otherwise(NONE).alias("kth"))
    by_block = kth.groupBy(F.col("q_cell").alias("cell"), F.col("q_part").alias("part")).agg(F.collect_list(F.struct("place", "kth")).alias("x"))  # a block's queries at most
    known = F.map_from_entries("x")
    all_kth = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(NONE)))
    bounded = cut(queries.join(by_block, ["cell", "part"], "left").withColumn("kth", F.when(F.col("x").isNotNull(), all_kth)).drop("x"), "thresholds")
    floor = bounded.select(F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("radius").alias("q_radius"), F.coalesce(F.array_min("kth"), F.lit(NONE)).alias("least"))
    worst = dict(tuple(r) for r in floor.groupBy("q_cell").agg(F.min("least")).collect())

    # pairs of cells whose bound reaches the worst kth score of the cell's queries
    left = []
    for c, r in own.items():
        most = inner[c] + r * norm + radius * norm[c] + r * radius
        most += 1e-9 * (norm[c] + r) * (norm + radius) + 1e-6
        for d in np.flatnonzero((size > 0) & (most >= worst[c])).tolist():
            left.append((c, d, -(-int(size[d]) // (p.block * GROUP)), float(inner[c, d]), float(norm[c]), float(norm[d])))
    near = _frame(spark, left, "q_cell int, d_cell int, groups int, inner double, q_norm double, d_norm double")
    # a cell of many blocks has them in groups, so that no key of the join holds more than GROUP of them
    near = near.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    blocks = data.select(F.col("cell").alias("d_cell"), F.col("part").alias("d_part"), F.floor(F.col("part") / GROUP).cast("int").alias("group"), F.col("radius").alias("d_radius"))
    most = F.expr("inner + q_radius * d_norm + d_radius * q_norm + q_radius * d_radius + 1e-9 * (q_norm + q_radius) * (d_norm + d_radius) + 1e-6")
    pairs = floor.join(near, "q_cell").join(blocks, ["d_cell", "group"]).where(most >= F.col("least")).select("q_cell", "q_part", "d_cell", "d_part")
    found = _searched(cut(pairs, "pairs"), bounded, data, width, p)
    return _ranked(found, p.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The contract's rules in DuckDB, for unique ids.
SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
 scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored QUALIFY rank <= 10"""
