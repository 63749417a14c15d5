"""The training-text pipeline: five stages over ``documents``, each a table of its own.

A stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of
documents; the last one adds where each row goes. run() writes each stage as Parquet to the
shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.llm import decontaminate, mixing, quality, sharding, simhash
from tidyloom.llm.common import saved
from tidyloom.llm.queries import GRADE, SHARDS, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, GRADE).where("keep").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates, the one with the smallest doc_id.

    Rows that share the smallest doc_id and their fingerprint are repeats: one stays, the
    first by its text.
    """
    return simhash.representatives(docs).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold too much of the benchmark."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources get their target weights."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every row in a shard and a slot."""
    return sharding.shard(docs, SHARDS).select(*docs.columns, "shard", "slot", "grown_shard")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier's decisions cannot be written in SQL; tests check run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
