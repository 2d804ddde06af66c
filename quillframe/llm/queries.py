"""The queries of the ten text operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import bpe, classifiers, decontamination, katz, simhash, site_templates, token_counts, token_output, winnowing
from quillframe.sources import tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose every row is work for Python, over all cores also where it is one small file."""
    return tables.spread(_table(spark, sf_dir, name))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_texts(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(_texts(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_texts(spark, sf_dir))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_texts(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifiers.quality_scores(_texts(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"), min_words=1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifiers.toxicity_grades(_texts(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_texts(spark, sf_dir))


def op9_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extract_text(_texts(spark, sf_dir, "pages"), min_share=0.02)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_texts(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_output, op2_fingerprints, op3_simhash, op4_katz, op5_quality, op6_decontamination, op7_toxicity, op8_bpe, op9_site_templates, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op2_fingerprints": winnowing.sql()}
