"""From raw documents to token ids: five stages, each one of the text operators.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage but the last
returns the columns of documents, whatever they are: other columns come along, whatever their names.
An empty table stays empty through all stages. Rows are judged each by its own text, so that repeated rows share
their fate, but for near_duplicates, of whose copies one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import bpe, classifiers, decontamination, shared, simhash
from quillframe.sources import tables


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the ordinal model rejects. Null texts stay; an empty or very long text is scored like any other; a score at the threshold goes."""
    return classifiers.keep_clean(docs, _labels(spark, sf_dir))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality model, fitted on those still here, rejects. Null texts go; a score at the threshold stays."""
    return classifiers.keep_good(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the least id. Null and empty texts and null ids are copies of nothing; of rows with one id the first by text stays."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, give or take its allowed edits, wherever in the text. Null and empty texts stay; exactly the allowed edits are enough."""
    return decontamination.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_words=1)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, a row for each; null for a null text, none for an empty one."""
    return bpe.encode_decode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Trained models, locality-sensitive hashing and BPE merges can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each keeps is written to the shared folder and read again."""
    docs = tables.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
