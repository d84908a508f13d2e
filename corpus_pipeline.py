"""A training-corpus pipeline over ``documents``: five stages, each on all that the one before kept.

Every stage is a function of (spark, docs, sf_dir) whose result is written as Parquet to the shared
scratch folder and read again as the next stage's ``docs``, so a lost executor costs at most the
stage that runs.  All but the last return the columns of ``documents``; the last returns a row per
kept document (a document that the mix repeats has a row per copy) with its shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from missaware.llm import leaks, mixing, neardup, rules, sharding
from missaware.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the rules reject go."""
    return rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near-duplicates stays, the one with the smallest id."""
    return neardup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a test item go."""
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document as often as the mix takes it (0 to 3 times)."""
    return mixing.remix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: shard and slot of every row."""
    return sharding.place(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: A Viterbi decoding and connected components have no plain SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
