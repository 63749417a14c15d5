"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Distributed union-find: every round hangs the neighbours of each node below the
smallest of them. Minima are combined in the map tasks and hubs only meet in joins,
whose hot keys adaptive execution splits, so no node's links are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import saved


def _hung(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links (a, b) with the smallest node ``m`` that ``a`` knows of, itself included."""
    return links.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return _hung(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = _hung(edges, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest of its component.

    Links may point either way, repeat or join a node to itself; without links the
    result is empty.
    """
    edges = saved(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        edges = saved(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
