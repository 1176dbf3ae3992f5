"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codebooks, covertree, registry, resample

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, score string, cell int, v string"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = c.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    at = [want.columns.index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def by_hand(docs, target, p):
    """Weights, scores and ranks by the contract's words, one document after the other."""

    def features(text):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if ord(c) > 127 or c.isdigit() and c.isascii() or "a" <= c <= "z" else " " for c in t).split(" ")
        words = [w for w in words if w]
        return len(words), [" ".join(words[i : i + n]) for n in range(1, p.grams + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % p.buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + p.buckets) / ((s[b] + 1) * (total_t + p.buckets))))
    rows = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= p.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(fit) * p.percent // 100
    ranks = defaultdict(list)
    for k, r in enumerate(fit[:drawn]):
        ranks[(r[0], r[3])].append(k + 1)
    return [(*r[:4], ranks[(r[0], r[3])].pop(0) if r[4] >= p.least_words and ranks[(r[0], r[3])] else None) for r in rows]


@pytest.mark.parametrize("p", [resample.Params(), resample.Params(grams=3, buckets=97, least_words=3, percent=50, seed=7)])
def test_resampling_equals_brute_force(spark, small, p):
    own = [(1, None), (2, ""), (3, "!!! ... "), (4, "Ünïcode ÀÉ straße 日本 x1y2"), (5, "word " * 30_000), (5, "word " * 30_000), (None, "no id at all " * 9), (6, "A_b-C d\x00e\x7ff"), (7, "same text " * 12), (8, "same text " * 12)]
    rows = own + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()] + [None, ""]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, weight string, rank int").repartition(5)
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = [tuple(r) for r in resample.resample(docs, goal, p).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[4] or 0)
    assert sorted(got, key=key) == sorted(by_hand(rows, target, p), key=key)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(one, none).first().rank is None


def lloyd(rows, p):
    """Plain Lloyd's rounds over all parts."""
    width = -(-max((len(v) for _, v, _ in rows), default=1) // p.parts) * p.parts
    x = np.array([[math.floor(p.scale * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v, _ in rows], np.int64).reshape(len(rows), p.parts, -1)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].reshape(-1).tolist()))[: p.entries]
    books = x[order].transpose(1, 0, 2).copy()
    for k in range(p.rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        entry = d.argmin(2)
        if k < p.rounds:
            for m in range(p.parts):
                for e in range(books.shape[1]):
                    mine = x[entry[:, m] == e, m]
                    if len(mine):
                        books[m, e] = [int(s) // len(mine) for s in mine.sum(0)]
    error = d.min(2).sum(1)
    labels = defaultdict(int)
    for (_, _, label), e in zip(rows, error.tolist(), strict=True):
        labels[label] += e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in entry[n]), int(error[n]), labels[label], digest) for n, (i, _, label) in enumerate(rows)]


def vectors(n, d, seed=1, spread=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d)) * spread
    out = [(int(i), [float(c) for c in (centres[i % 5] + rng.normal(size=d)).astype(np.float32)], int(i % 3) if i % 4 else None) for i in rng.permutation(n)]
    same = [float(np.float32(0.25))] * d
    return out + [(n + i, same, 7) for i in range(n // 3)]  # a third are copies


BAD = [(1, None, 1), (2, [1.0, None], 1), (3, [NAN, 1.0], 2), (4, [INF, 0.0], None), (5, [-INF, 0.0], None)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 3, "w") for i, v, label in rows], VECTORS).repartition(6)


@pytest.mark.parametrize(("p", "d"), [(codebooks.Params(), 32), (codebooks.Params(parts=3, entries=5, rounds=6, scale=10), 10), (codebooks.Params(parts=2, entries=256, rounds=3), 4), (codebooks.Params(parts=2, entries=1), 2)])
def test_codes_equal_plain_lloyd(spark, p, d, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK", 50)
    rows = vectors(150, d)
    rows += [rows[0], (None, rows[1][1], None), (9999, [], 1), (9998, [1.0], 2), (rows[2][0], rows[3][1], 1)]  # repeated, without id, short, one id twice
    got = [tuple(r) for r in codebooks.compress(table(spark, rows + BAD), p).collect()]
    assert sorted(map(str, got)) == sorted(map(str, lloyd(rows, p)))


def test_heaps_spare_work_and_stay_exact():
    rng = np.random.default_rng(5)
    p = 4
    x = np.concatenate([rng.normal(c * 1000, 20, size=(200, p, 2)) for c in range(8)]).astype(np.int64)
    books = codebooks.Books(np.ascontiguousarray(x[::200].transpose(1, 0, 2)), np.zeros((p, 8)))
    block = codebooks.Block(x, np.zeros((len(x), p), np.uint8))
    total, scanned = np.zeros((p, 8, 3), np.int64), []
    for _ in range(5):
        codebooks.assign(block, books)
        assert (block.entry == ((x[:, :, None, :] - books.entries[None]) ** 2).sum(3).argmin(2)).all()
        total += block.delta.reshape(p, 8, 3)
        for m in range(p):
            assert (total[m, :, 2] == np.bincount(block.entry[:, m], minlength=8)).all()
        scanned.append(block.scanned)
        n = total[:, :, -1:]
        books = books.moved(np.where(n > 0, total[:, :, :-1] // np.maximum(n, 1), books.entries))
    assert scanned[0] == x.shape[0] * p and max(scanned[1:]) < scanned[0] / 10


def test_codes_of_nothing(spark):
    assert codebooks.compress(table(spark, []).limit(0)).count() == 0
    assert codebooks.compress(table(spark, BAD)).count() == 0


def best(rows, p):
    """All products of all queries, sorted."""
    width = max((len(v) for _, v, _ in rows), default=1)
    x = np.array([[math.floor(p.scale * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v, _ in rows], object).reshape(len(rows), width)
    out, asked = [], set()
    for (i, _, _), q in zip(rows, x, strict=True):
        if i % p.every == 0 and (i, tuple(q)) not in asked:
            asked.add((i, tuple(q)))
            scores = sorted((-int(s), j) for (j, _, _), s in zip(rows, x.dot(q), strict=True) if j != i)
            out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[: p.k])]
    return sorted(out)


@pytest.mark.parametrize(("p", "d"), [(covertree.Params(every=10), 8), (covertree.Params(every=7, k=3, block=20, block_queries=4, leaf=4, cells=6, sample=50), 3), (covertree.Params(every=5, block=16, block_queries=2, leaf=2, cells=9), 24)])
def test_top_products_equal_brute_force(spark, p, d):
    rows = vectors(210, d, spread=0.5)
    rows += [rows[0], rows[0], (9990, [], 1), (9995, [1.0], 2), (rows[2][0], rows[3][1], 1), (-70, rows[4][1], 1)]  # repeated, short, one id twice, negative
    got = sorted(tuple(r) for r in covertree.top(table(spark, [*rows, *BAD, (None, rows[5][1], 1)]), p).collect())
    assert got == best(rows, p)


def test_the_trees_prune_and_big_numbers_stay_exact():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(250, 3)) * 5 + c for c in rng.normal(size=(8, 3)) * 2000]).astype(np.int64)
    data, q = covertree.Tree(np.arange(len(v)), v, 16), covertree.Tree(np.arange(0, len(v), 100), v[::100], 4)
    found = covertree.Best.none(len(q.ids), 5)
    made = covertree.search(q, data, found, np.full(len(q.ids), covertree.NONE))
    assert made < len(v) * len(q.ids) / 3
    for i, row in zip(q.ids, range(len(q.ids)), strict=True):
        s = sorted((-int(x), j) for j, x in enumerate(v @ v[i]) if j != i)[:5]
        assert [(-a, j) for a, j in s] == list(zip(found.score[row].tolist(), found.id[row].tolist(), strict=True))
    big = np.array([[2**30, -(2**30)], [2**30 - 1, 2**29], [3, 5]])
    t = covertree.Tree(np.arange(3), big, 8)
    assert (covertree.products(t, t.root, t, t.root) == t.v @ t.v.T).all()


def test_top_products_of_nothing(spark):
    assert covertree.top(table(spark, []).limit(0)).count() == 0
    assert covertree.top(table(spark, BAD)).count() == 0
    assert covertree.top(table(spark, [(100, [1.0], 1)])).count() == 0
    assert [tuple(r) for r in covertree.top(table(spark, [(100, [1.0], 1), (1, [2.0], 1)])).collect()] == [(100, 1, 1, 2 * 1024 * 1024)]
