"""Slices, scans, chains and ranks against plain windows and loops, with keys of null, gaps and ties."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.chains import NEVER, chained
from tidemark.plans.joins import as_of
from tidemark.plans.rank import ranked
from tidemark.plans.scan import last_known
from tidemark.plans.slices import halo, own, positions


def history(spark, n=700):
    rng = random.Random(5)
    rows = []
    for k in ("a", "b", None):
        for t in sorted(rng.sample(range(0, 86400 * 40, 600), n)):
            rows.append((k, t, rng.randrange(1000) if rng.random() < 0.3 else None))
    return spark.createDataFrame(rows, "k string, t long, v long").repartition(3)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_positions_and_slices_equal_whole_windows(spark):
    df = history(spark)
    w = Window.partitionBy("k").orderBy("t")
    assert same(positions(df, ["k"], ["t"]), df.withColumn("_pos", F.row_number().over(w) - 1))
    rows, keys = halo(df, ["k"], ["t"], 20, 3)
    x = Window.partitionBy(*keys).orderBy("t")
    got = own(rows.withColumns({"a": F.collect_list("t").over(x.rowsBetween(-20, 3)), "b": F.lag("t", 2).over(x)}))
    want = df.withColumns({"a": F.collect_list("t").over(w.rowsBetween(-20, 3)), "b": F.lag("t", 2).over(w)})
    assert same(got, want)
    assert rows.select("_slice").distinct().count() > 3


def test_no_plan_of_slices_deals_by_key_alone(spark):
    rows, keys = halo(history(spark), ["k"], ["t"], 2)
    plan = own(rows.withColumn("b", F.lag("t", 2).over(Window.partitionBy(*keys).orderBy("t"))))._jdf.queryExecution().executedPlan().toString()
    alone = [line for line in plan.splitlines() if "hashpartitioning(k#" in line and "_slice" not in line and "_bucket" not in line]
    # what is dealt by the key alone are counts, a row a bucket
    assert all("_n" in plan for _ in alone) and "_slice" in plan


def test_last_known_and_as_of(spark):
    df = history(spark)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    got = last_known(df.withColumn("d", F.floor(F.col("t") / 86400)), ["k"], "d", ["t"], "v", "last").drop("d")
    assert same(got, df.withColumn("last", F.last("v", ignorenulls=True).over(w)))
    right = df.where("v IS NOT NULL").select("k", F.col("t").alias("at"), F.col("v").alias("seen"))
    joined = {(r.k, r.t): r.seen for r in as_of(df.select("k", "t"), right, ["k"], "t", "at", ["seen"]).collect()}
    assert joined == {(r.k, r.t): r["last"] for r in got.collect()}


def test_chains_equal_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for k in range(4):
        for t in sorted(rng.sample(range(3000), 300)):
            end = t + (rng.choice([0, 1, 5, 60, 61]) if k % 2 else rng.randrange(0, 700 if k == 2 else 80))
            rows.append((f"k{k}" if k else None, t, NEVER if t > 2900 and rng.random() < 0.3 else end))
    df = spark.createDataFrame(rows, "k string, s0 long, e0 long").repartition(5)
    free, want = {}, []
    for k, t, e in rows:
        taken = t >= free.get(k, -NEVER)
        free[k] = e if taken else free[k]
        want.append((str(k), t, taken))
    for width in (10, 240, 5000):
        assert sorted((str(r.k), r.s0, r.taken) for r in chained(df, ["k"], "s0", "e0", width).collect()) == sorted(want)
    assert chained(df.limit(0), ["k"], "s0", "e0", 10).count() == 0


def test_ranks_of_ties_and_none(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)] + [(3, -1)] * 300, "x int, i long").repartition(6)
    got = ranked(df, [F.desc("x"), F.asc("i")]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 801))
    in_order = sorted(got, key=lambda r: r["rank"])
    assert [(r.x, r.i) for r in in_order] == sorted(((r.x, r.i) for r in got), key=lambda p: (-p[0], p[1]))
    assert ranked(df.limit(0), [F.asc("i")]).count() == 0
