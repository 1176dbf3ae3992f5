"""Connected components of links as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def components(edges: DataFrame, name: str) -> DataFrame:
    """node and root (the smallest node it can reach) for each node of the edges (a, b).

    Alternates large-star and small-star steps, each a minimum per node and a
    join, until the links are stars around their roots. Links are written to the
    shared folder after each round; nothing but two flags comes to the driver.
    Loops are ignored; no edges give no rows.
    """
    links = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a")
        small = near.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        links = cut(small.distinct(), name)
        # stars: every node has one link, and no root has one
        twice = links.groupBy("a").count().where("count > 1")
        if twice.isEmpty() and links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
