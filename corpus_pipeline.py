"""The corpus pipeline: stages over documents, each written and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, jaccard, language, suffix
from tidemark.llm.common import cut, documents

#: Near duplicates of the pipeline: shingles of five words, likeness of at least 80 percent.
NEAR = jaccard.Params(words=5, percent=80)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the string-kernel classifier tells; it learns from the rows that are not held out."""
    return language.accepted(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return jaccard.one_of_each(docs, NEAR)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out."""
    return suffix.without_copies(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path(bpe.MULTI_50K))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_near),
    ("suffix_array_dedup", without_repeats),
    ("decontamination", without_leaks),
    ("byte_bpe", encoded),
]

#: No stage but the first filters can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
