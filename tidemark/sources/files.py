"""Files in and out: bar archives, reports, journals, synthetic bars, chunked reads (SRC, SNK)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = "time long, open double, high double, low double, close double, tick_volume long, spread double, real_volume long"


def read_archive(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of a JSON array file, gzipped or not (SRC1). A missing or broken file is an error."""
    rows = spark.read.schema(BAR).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.lit(symbol).alias("symbol"), F.col("time").alias("epoch_s"), "open", "high", "low", "close", "tick_volume", "spread", "real_volume")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A JSON document from any file system that Spark reads (SRC2)."""
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bars as Parquet by symbol and month (SNK1, SNK2); readers prune both. Spark's committer makes the write all or nothing."""
    bars.withColumn("month", F.date_format(F.timestamp_seconds("epoch_s"), "yyyy-MM")).repartition("symbol", "month").write.mode(mode).partitionBy("symbol", "month").parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON lines or CSV (SNK4, SNK5); in CSV what is undefined reads N/A."""
    if kind == "csv":
        report.select([F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in report.columns]).write.mode("overwrite").option("header", True).csv(path)
    else:
        report.write.mode("overwrite").json(path)


def append_journal(stream: DataFrame, path: str, checkpoint: str):
    """A streaming journal as JSON lines (SNK6); start() of the returned writer runs it."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def synthetic_bars(spark: SparkSession, symbols: list[str], n: int, seconds: int = 60, start: int = 1_704_067_200, seed: int = 42) -> DataFrame:
    """A random walk for each symbol (SRC9): the same for a seed, whatever the partitions."""
    k = F.col("id") % n
    s = F.element_at(F.array(*[F.lit(x) for x in symbols]), (F.floor(F.col("id") / n) + 1).cast("int"))
    draw = lambda j: (F.pmod(F.xxhash64(F.lit(seed), F.lit(j), "symbol", "k"), F.lit(2_000_001)) - 1_000_000) / 1e6
    rows = spark.range(len(symbols) * n).select(s.alias("symbol"), k.alias("k"))
    w = Window.partitionBy("symbol").orderBy("k")
    walk = rows.withColumn("close", F.round(2000 + F.sum(F.round(draw(0), 4)).over(w), 2))
    walk = walk.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    return walk.select(
        "symbol", (start + F.col("k") * seconds).alias("epoch_s"), "open",
        F.round(F.greatest("open", "close") + F.abs(draw(1)) * 0.5, 2).alias("high"),
        F.round(F.least("open", "close") - F.abs(draw(2)) * 0.5, 2).alias("low"),
        "close", (1 + F.pmod(F.xxhash64(F.lit(seed), "symbol", "k"), F.lit(200))).alias("tick_volume"), F.lit(0.3).alias("spread"),
    )


def chunks(start: int, end: int, days: int, overlap_s: int = 3600) -> list[tuple[int, int, int]]:
    """Ranges (number, from, to) that cover start..end backwards, each reaching an hour into the one before (SRC5)."""
    out, hi = [], end
    while hi > start:
        lo = max(start, hi - days * 86400)
        out.append((len(out), lo, hi))
        if lo == start:
            break
        hi = lo + overlap_s
    return out


def read_chunked(spark: SparkSession, ranges: list[tuple[int, int, int]], fetch: Callable[[int, int], pd.DataFrame], symbol: str) -> tuple[DataFrame, DataFrame]:
    """Bars that fetch(from, to) gives for each range, one task a range, and a manifest of the chunks (SRC5, SRC6).

    Where ranges overlap the chunk of the smaller number wins. fetch runs on executors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                got = fetch(int(r.lo), int(r.hi))
                if len(got):
                    yield got.assign(chunk=r.chunk)[["chunk", "epoch_s", "open", "high", "low", "close", "tick_volume"]]

    plan = spark.createDataFrame(ranges, "chunk int, lo long, hi long").repartition(max(1, len(ranges)), "chunk")
    got = plan.mapInPandas(run, "chunk int, epoch_s long, open double, high double, low double, close double, tick_volume long")
    return merged_chunks(got.withColumn("symbol", F.lit(symbol)), ranges)


def merged_chunks(got: DataFrame, ranges: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """Bars of all chunks (symbol, chunk, epoch_s and prices), of each time that of the smallest chunk number, and the manifest of the chunks."""
    plan = got.sparkSession.createDataFrame(ranges, "chunk int, lo long, hi long")
    w = Window.partitionBy("symbol", "epoch_s").orderBy("chunk")
    rows = got.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "chunk")
    manifest = plan.join(got.groupBy("chunk").agg(F.count(F.lit(1)).alias("bars")), "chunk", "left").select("chunk", "lo", "hi", F.coalesce("bars", F.lit(0)).alias("bars"), F.when(F.col("bars") > 0, "SUCCESS").otherwise("EMPTY").alias("status"))
    return rows, manifest
