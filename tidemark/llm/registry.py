"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, codebooks, covertree, decontaminate, imatch, jaccard, language, licenses, resample, separators, suffix, toxicity, vbyte
from tidemark.llm.common import documents


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.production(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vbyte.production(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir))


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.production(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.production(documents(spark, sf_dir))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_spaced_seeds": op1_spaced_seeds,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_imatch": op4_imatch,
    "op5_suffix_repeats": op5_suffix_repeats,
    "op6_token_counts": op6_token_counts,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_files": op8_token_files,
    "op9_language": op9_language,
    "op10_licenses": op10_licenses,
    "op11_resample": op11_resample,
    "op12_codebooks": op12_codebooks,
    "op13_top_products": op13_top_products,
}
ORACLES: dict[str, str] = {"op11_resample": resample.SQL, "op12_codebooks": codebooks.sql(64), "op13_top_products": covertree.SQL}
