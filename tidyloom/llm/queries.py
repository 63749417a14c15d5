"""Registered queries of the package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.llm import conversations, decontaminate, line_dedup, main_text, metric_search, mixing, periodic, quality, rules, sharding, simhash, substrings, toxicity

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 24
POLICY = "v2"
#: Lowest grade that selection keeps.
GRADE = 1
#: Every so-many-th vector is a query, for so many results.
ASKED, RESULTS = 20, 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without its near-duplicate lines."""
    cut = line_dedup.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade of every document and whether its quality is good enough."""
    docs, labels = (table(spark, folder, n) for n in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    return quality.score(docs, quality.train(docs, labels), GRADE).drop("text")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The article of every page."""
    return main_text.main_text(table(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op5_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without its repeated passages."""
    cut = substrings.repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs, benchmark = (table(spark, folder, n) for n in ("documents", "benchmark"))
    found = decontaminate.contamination(docs.select("doc_id", "text"), benchmark).drop("text")
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(listed, "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and class of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op8_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of every document and its verdict."""
    judged = rules.apply_policy(rules.ledger(table(spark, folder, "documents").select("doc_id", "text")), POLICY)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "fail_bits", "base_failed", "kept"
    )


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document."""
    placed = sharding.shard(table(spark, folder, "documents").select("doc_id", "text"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of the categories of the chain for every document."""
    docs, labels = (table(spark, folder, n) for n in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, labels)).drop("text").withColumn("toxic", F.col("is_toxic"))


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    rows = conversations.damaged(table(spark, folder, "conversations"))
    return conversations.summaries(rows, gone=F.col("gone"))


def op12_products(spark: SparkSession, folder: str) -> DataFrame:
    """The highest inner products of every twentieth vector with all others."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return metric_search.top_products(rows, F.col("vec_id") % ASKED == 0, RESULTS)


def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document, some of them planted."""
    docs = periodic.planted(table(spark, folder, "documents"))
    return periodic.runs(docs, keep=False).drop("n_words")


QUERIES: dict[str, Query] = {
    "op1_lines": op1_lines,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_main_text": op4_main_text,
    "op5_substrings": op5_substrings,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_rules": op8_rules,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_conversations": op11_conversations,
    "op12_products": op12_products,
    "op13_periodic": op13_periodic,
}
