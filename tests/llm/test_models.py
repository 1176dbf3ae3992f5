"""Operators 3, 9 and 10, the pipeline, and the registry."""

import functools
import itertools
import math
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, licenses, registry, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) for r in told)
    own = [r for r in told if r.held_out and r.lang]
    assert sum(r.lang_pred == r.lang for r in own) / len(own) > 0.97
    assert language.accepted(docs).count() >= 0.97 * docs.count()


def test_language_edges(spark):
    rows = [(i, t, l, None, None) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 10 + [(None, "en"), ("", "de"), ("123 !?", "en"), ("the " * 50_000, None)])]
    docs = spark.createDataFrame([*rows, rows[0]], SCHEMA).withColumn("lang_pred", F.lit("clash"))
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert [got[i].lang_pred for i in (20, 21, 22, 23)] == ["und", "und", "und", "en"]
    assert language.identify(docs.limit(0)).count() == 0
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and 20 not in {r.doc_id for r in kept.collect()}


def test_kernel_is_that_of_explicit_sets(spark):
    texts = [r.text.lower() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 50 and 400").orderBy("doc_id").limit(25).collect()] + ["straße, straße", "a", "日本語 1234"]
    rng = np.random.default_rng(7)
    texts += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     éß語"), n)) for n in (30_000, 300_000)]
    sets = []
    for t in texts:
        raw = bytes(x if x > 127 or 97 <= x <= 122 else 32 for x in t.encode())
        sets.append({raw[i : i + n] for n in range(1, 5) for i in range(len(raw) - n + 1)})
    got = []
    for _, first, grams in language.presence(pa.array(texts)):
        got += [grams[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert [len(g) for g in got] == [len(x) for x in sets]
    have = language.kernel_of(got, got, np.unique(np.concatenate(got)))
    for a, b in itertools.product(range(len(texts)), repeat=2):
        assert abs(len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b])) - have[a, b]) < 1e-5


def test_gibberish_and_unlearned_languages_are_rejected(spark):
    rng = np.random.default_rng(1)
    junk = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n)) for n in (5, 20, 60, 300, 1000)]
    junk += ["kissa nukkuu sohvalla ja sade putoaa hitaasti kaupungin ylle", "кошка спит на диване пока дождь медленно падает на город", "asdf jkl; asdf jkl; qwerty", "日本語のテキスト"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    planted = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate(junk)], docs.schema)
    kept = [r.doc_id for r in language.accepted(docs.unionByName(planted)).select("doc_id").collect()]
    assert not [i for i in kept if i >= 10_000_000]
    assert len(kept) >= 0.97 * docs.count()


def test_all_languages_are_learned(spark):
    rng = np.random.default_rng(2)
    own = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(6)] for _ in range(70)]
    rows = [(70 * j + c, " ".join(rng.permutation(own[c]).tolist()), f"l{c:02}") for j in range(12) for c in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert {told[i] for i, _, _ in rows} == {x for _, _, x in rows}


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    order = s.argsort()
    ranks = np.empty(len(s))
    ranks[order] = np.arange(len(s))
    n1 = y.sum()
    auc = (ranks[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))
    told = s >= 0.5
    print("auc", auc, "caught", told[y == 1].mean(), "left alone", 1 - told[y == 0].mean())
    assert auc > 0.9, auc
    assert told[y == 1].mean() > 0.9 and told[y == 0].mean() < 0.05


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([None, "", "you stupid idiot", "a fine day", "x" * 200_000])] + [(0, None, None, None, None)], SCHEMA).withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(2, 1, 1), (3, 1, 0), (3, 0, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_label_model_equals_enumeration_and_counts_correlated_voters_once():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    one = np.where(rng.random(4000) < 0.9, y, ~y)
    votes = np.column_stack([one, one, one, np.where(rng.random(4000) < 0.85, y, ~y), np.where(rng.random(4000) < 0.85, y, ~y)])
    model, q = toxicity.label_model(votes, 0.3, 30)
    # the posterior by summing the joint chances, one factor a voter
    for row in itertools.product([0, 1], repeat=5):
        joint = [model.prior if c else 1 - model.prior for c in (0, 1)]
        for c in (0, 1):
            for j, v in enumerate(row):
                joint[c] *= model.tables[c, j, row[model.parent[j]], v]
        assert model.posterior(np.array([row], bool))[0] == pytest.approx(joint[1] / sum(joint), rel=1e-6)
    # three copies of a voter count once: two independent ones of some less accuracy outweigh them
    assert model.posterior(np.array([[1, 1, 1, 0, 0]], bool))[0] < 0.5 < model.posterior(np.array([[0, 0, 0, 1, 1]], bool))[0] + 0.35
    accuracy = [(model.tables[1, j, :, 1].max(), model.tables[0, j, :, 1].min()) for j in (3, 4)]
    assert all(a > 0.75 and b < 0.25 for a, b in accuracy)
    assert ((q > 0.5) == y).mean() > 0.9


def test_samples_are_bounded_by_each_label(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'x' as text")
    labels = spark.range(1500).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic")
    n = {r["y"]: r["count"] for r in toxicity.draw(docs, labels, toxicity.Params(50, 20, 10))[0].groupBy("y").count().collect()}
    assert n == {1: 50, 0: 20, -1: 10}
    n = {r["y"]: r["count"] for r in toxicity.draw(docs, labels, toxicity.Params(20, 5000, 10))[0].groupBy("y").count().collect()}
    assert n[1] == 20 and n[0] == sum(i % 3 != 0 and not held(i) for i in range(1500)) and n[-1] == 10


def brute_licences():
    """A function of a text: its licence and score, in plain Python over dicts."""
    terms = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    bags = [(name, Counter(terms(t))) for name, t in licenses.TEMPLATES]
    idf = lambda x: math.log((1 + len(bags)) / (1 + sum(x in bag for _, bag in bags))) + 1
    idf = functools.cache(idf)
    weighed = [(name, {x: n * idf(x) for x, n in bag.items()}) for name, bag in bags]
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    weighed = [(name, v, length(v)) for name, v in weighed]

    def units(text):
        run, kind = [], None
        for line in [*text.split("\n"), ""]:
            yield line
            now = None if not terms(line) else line.strip(" \t\r\v\f")[0] in "#/*;%!|<"
            if now is None or now != kind:
                yield "\n".join(run)
                run = []
            if now is not None:
                run.append(line)
            kind = now
        yield text

    def best(text):
        out, most = (None, 0.0), 0.0
        for u in units(text or ""):
            bag = Counter(terms(u))
            if not any(x in v for x in bag for _, v, _ in weighed):
                continue
            mine = {x: n * idf(x) for x, n in bag.items()}
            for name, v, size in weighed:
                covered = sum(w * v.get(x, 0) for x, w in mine.items()) / size
                if covered >= 0.7 * length(mine) and covered > most + 1e-6:
                    out, most = (name, covered / length(mine)), covered
        return out

    return best


def test_licences_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = ["# " + t for _, t in licenses.TEMPLATES] + [f"int x;\n// {t[:40]}\n// {t[40:]}\nint y;" for _, t in licenses.TEMPLATES] + ["\n\n", "a\n\n\nb", None]
    own = spark.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    docs = docs.where("n_chars < 3000").select("doc_id", "text", "lang", "source", "n_chars").unionByName(own)
    best = brute_licences()
    want = {r.doc_id: best(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.licence if r.origin == "own" else None, r.score) for r in licenses.production(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(v[1], abs=1e-6) for k, v in want.items())
    assert all(got[10**6 + i][0] for i in range(len(licenses.TEMPLATES)))


def test_licence_texts_are_found_beside_many_documents(spark):
    whole = {name: next(t for n, t in licenses.TEMPLATES if n == name and t.count("\n") > 1) for name in ("MIT", "BSD-3-Clause", "BSD-2-Clause")}
    wrapped = "\n".join(f" * {x}" for x in textwrap.wrap(licenses._MIT, 40))
    rows = [(name, f"Copyright (c) 2020 A. Name\n\n{t}") for name, t in whole.items()] + [("wrapped", f"/*\n{wrapped}\n */\nint main() {{}}\n" * 3)]
    rng = np.random.default_rng(4)
    rows += [(f"x/{i}", " ".join(rng.choice(["the", "of", "provided", "code", "w1", "w2", "w3"], 30))) for i in range(10_000)]
    files = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit("clash") for c in ("licence", "score", "edge", "gives", "dir", "origin", "near")})
    got = {r.path: (r.licence, r.origin) for r in licenses.scan(files).where("licence is not null").collect()}
    assert got == {name: (name, "own") for name in whole} | {"wrapped": ("MIT", "own")}


def test_licences_come_from_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = spark.createDataFrame([("LICENSE", mit), ("a/b/COPYING.txt", gpl), ("a/x.py", "code"), ("a/b/c/d/y.py", "code"), ("a/b/z.py", f"code\n{mit}\nmore"), ("top.py", None), (None, ""), ("ab/q.py", "w " * 100_000), ("a/x.py", "code")], "path string, text string")
    got = {r.path: (r.licence, r.origin, r.from_dir) for r in licenses.scan(files).collect()}
    assert got["a/x.py"] == ("MIT", "inherited", "") and got["ab/q.py"] == ("MIT", "inherited", "")
    assert got["a/b/c/d/y.py"] == ("GPL-3.0", "inherited", "a/b")
    assert got["a/b/z.py"] == ("MIT", "own", None) and got["top.py"][1] == "inherited"
    assert licenses.scan(files.limit(0)).count() == 0
    assert licenses.scan(files.where("path LIKE 'a/x%'")).where("origin <> 'none'").count() == 0


def test_licences_of_deep_directories_are_not_broadcast(spark):
    mit = "Released under the MIT License."
    top = lambda i: "/".join([f"t{i}", *(f"level{k}" for k in range(100))])
    rows = [(f"{top(i)}/LICENSE", mit) for i in range(300)] + [(f"{top(i)}/low/x.py", "code") for i in range(0, 300, 30)] + [("t0/x.py", "code")]
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")  # directories with all their ancestors are more
    try:
        got = {r.path: (r.licence, r.origin, r.from_dir) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)
    assert got == {p: ("MIT", "own", None) if t == mit else (None, "none", None) if p == "t0/x.py" else ("MIT", "inherited", p.removesuffix("/low/x.py")) for p, t in rows}


def test_registry_has_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, small):
    import corpus_pipeline as c

    docs = c.documents(spark, small)
    first = docs.columns
    for name, stage in c.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = c.cut(stage(spark, docs, small), f"test-{name}")
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before and len(after) >= 0.7 * len(before), name
        if name != c.STAGES[-1][0]:
            assert out.columns == first
        docs = out
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, c.run(spark, small).collect()))


def test_calibration_does_not_depend_on_how_many_were_drawn():
    rng = np.random.default_rng(4)
    y = (rng.random(40_000) < 0.1).astype(int)
    raw = rng.normal(size=len(y)) + 2 * y
    whole = toxicity.calibrated(raw, y)
    some = np.flatnonzero((y == 1) | (rng.random(len(y)) < 0.2))
    assert np.allclose(whole, toxicity.calibrated(raw[some], y[some], float(y.mean())), atol=0.1)
    assert abs(toxicity.calibrated(raw[some], y[some])[1] - whole[1]) > 0.5
