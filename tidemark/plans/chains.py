"""Chains of spans in which each one begins when the one before it has ended, without a task that reads a whole key.

Of the spans of a key, sorted by start, the first is taken, then the first that
does not start before it ends, and so on. What a time block does to the moment
from which the key is free depends on that moment alone, and only through the
spans of the block that start before all earlier spans have ended, and the first
one after these. So blocks are followed from each of these in parallel, the
blocks' maps are composed in order, and each block is followed once more from
where it really begins. Where a block starts after all earlier spans have ended
it begins with its first span whatever came before, so the composition is cut
there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: Before and after any time.
EARLY, NEVER = -(1 << 62), 1 << 62


def chained(df: DataFrame, by: list[str], start: str, end: str, width: int, name: str = "taken") -> DataFrame:
    """df with whether a span (start, end: whole numbers, end NEVER if it has none) is in its key's chain.

    width is the length of a block; four times that of a usual span keeps what
    is composed small. df is computed once and written, as its rows are
    followed twice. Spans of equal start are followed in order of their end.
    """
    df = written(df, "spans")
    # a struct is equal to another of the same nulls
    rows = df.select(F.struct(*df.columns).alias("_row"), F.struct(*by).alias("_key"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    keys = ["_key"]
    blocks = rows.groupBy(*keys, F.floor(F.col("s") / width).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("s", "e", "_row"))).alias("_spans"))
    blocks = blocks.withColumns({"_first": F.col("_spans")[0]["s"], "_most": F.array_max(F.transform("_spans", lambda x: x["e"]))})

    # the end of all spans of earlier blocks, and whether a block starts after it
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    heads = blocks.select(*keys, "_block", "_first", "_most").withColumn("_busy", F.coalesce(F.max("_most").over(earlier), F.lit(EARLY)))
    heads = heads.withColumn("_segment", F.sum((F.col("_first") >= F.col("_busy")).cast("int")).over(upto)).select(*keys, "_block", "_busy", "_segment")
    blocks = blocks.join(heads, [*keys, "_block"])

    # what a chain that enters a block at one of its possible entries leaves behind
    follow = lambda spans, free: F.aggregate(spans, free, lambda a, x: F.when(x["s"] >= a, x["e"]).otherwise(a))
    bare = F.transform("_spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    inner = F.size(F.filter("_spans", lambda x: x["s"] < F.col("_busy")))
    entries = F.slice("_bare", F.lit(1), F.least(inner + 1, F.size("_bare")))
    leaves = F.transform(entries, lambda x: F.struct(x["s"].alias("s"), follow(F.filter("_bare", lambda y: y["s"] >= x["s"]), x["s"]).alias("e")))
    maps = blocks.withColumn("_bare", bare).select(*keys, "_segment", "_block", leaves.alias("_map"))

    # composed in order: a row a block, of its possible entries only
    step = lambda a, x: F.struct(F.coalesce(F.try_element_at(F.filter(x["map"], lambda y: y["s"] >= a["free"]), F.lit(1))["e"], a["free"]).alias("free"), F.array_append(a["out"], F.struct(x["block"].alias("block"), a["free"].alias("free"))).alias("out"))
    none = F.struct(F.lit(EARLY).alias("free"), F.array().cast("array<struct<block:bigint,free:bigint>>").alias("out"))
    order = F.array_sort(F.collect_list(F.struct(F.col("_block").alias("block"), F.col("_map").alias("map"))))
    begun = maps.groupBy(*keys, "_segment").agg(order.alias("_maps")).select(*keys, F.explode(F.aggregate("_maps", none, step)["out"]).alias("x")).select(*keys, F.col("x.block").alias("_block"), F.col("x.free").alias("_free"))

    # each block from where it begins
    taken = lambda a, x: F.struct(F.when(x["s"] >= a["free"], x["e"]).otherwise(a["free"]).alias("free"), F.array_append(a["out"], x["s"] >= a["free"]).alias("out"))
    start_ = F.struct(F.col("_free").alias("free"), F.array().cast("array<boolean>").alias("out"))
    done = blocks.join(begun, [*keys, "_block"]).withColumn("_taken", F.aggregate("_spans", start_, taken)["out"])
    return done.select(F.explode(F.arrays_zip("_spans", "_taken")).alias("z")).select("z._spans._row.*", F.col("z._taken").alias(name))
