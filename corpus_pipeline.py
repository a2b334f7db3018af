"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage is a function of (spark, docs, sf_dir) that calls one operator of
``graphloom.llm``.  All but the last return the columns of ``documents``.

Nulls: a null text is in no language and goes in the first stage; a null id is
kept, after all others where one of several stays; a null source is a source of
its own, a null language only keeps a document from being learned from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontam, langid, mixing, sharding, simhash
from graphloom.llm.common import Stored

#: A language is rejected below this probability; with four languages chance alone gives 0.25.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language stay."""
    return langid.identified(docs, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return sharding.shard(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("shards", shards),
]

#: SQL can express neither the classifier nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        done = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if held:
            held.drop()
        docs, held = done.df, done
    return STAGES[-1][1](spark, docs, sf_dir)
