"""The corpus pipeline: language, near duplicates, benchmark leaks, mixing, sharding. Each stage reads what the one before wrote.

Defined results: empty tables pass through every stage; null and wordless texts go in the first stage as they have no language;
null doc_ids, null sources, repeated rows and any further columns are kept as each stage's docstring says; no stage adds columns
but the last, whose rows are those of the mix with their shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.llm.decontamination import without_leaks
from tempora.llm.langid import recognised
from tempora.llm.minhash import one_of_each
from tempora.llm.mixing import repeated
from tempora.llm.sharding import shard_documents
from tempora.plans.scratch import materialize

SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), the one of smallest doc_id.

    Rows that repeat in all columns stay once; rows of one doc_id with different texts are told apart; rows without words or
    without a doc_id stay.
    """
    return one_of_each(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row."""
    return shard_documents(docs, SHARDS)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
ORACLE_SQL = None  # the stages are no single SQL query; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
