"""Exact medians by radix selection, for all groups and columns together.

A double becomes a whole number of the same order. Four rounds at most find the one at a
position, 20 bits at a time from the top: a histogram of the next bits, counted in
the map tasks, tells in which of at most a million bins the position lies, and only the values
of that bin are looked at in the next round. No task sorts or holds the values of a group,
however large, and there is one way for all sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.session import written

#: Bits of a round: few rounds, and histograms that a task sorts in memory.
BITS = 20
#: Bits of a double without its sign.
SIZE = (1 << 63) - 1


def sort_key(value: Column) -> Column:
    """Whole number that sorts like the double: both zeros alike, NaN after all others."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("long")
    size = bits.bitwiseAND(F.lit(SIZE))
    return F.when(value == 0, F.lit(0).cast("long")).when(value < 0, -size).otherwise(size)


def of_key(key: Column) -> Column:
    """The double that a number stands for."""
    size = F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), F.abs(key)).cast("double")
    return F.when(key < 0, -size).otherwise(size)


def exact_medians(values: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Median of ``value`` for each group of ``by``, as columns ``by`` and ``median``; nulls do not count."""
    named = {name: f"__g{i}" for i, name in enumerate(by)}
    groups = list(named.values())
    doubles = values.select(*(F.col(n).alias(g) for n, g in named.items()), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    keys = written(doubles.select(*groups, sort_key(F.col("v")).alias("key")))
    state, shift = None, 64
    while shift and (state is None or not state.where(~F.col("found")).isEmpty()):
        above, shift = shift, max(0, shift - BITS)
        state = written(_next(keys, state, groups, above, shift))
    middles = state.select(*groups, of_key(F.col("prefix")).alias("x"))
    median = F.when(F.min("x") == F.max("x"), F.min("x")).otherwise((F.min("x") + F.max("x")) / 2)
    return middles.groupBy(*groups).agg(median.alias("median")).withColumnsRenamed({g: n for n, g in named.items()})


def _next(keys: DataFrame, state: DataFrame | None, groups: list[str], above: int, shift: int) -> DataFrame:
    """Bins ``(groups, prefix, low, high, found)`` that hold the two middle positions of groups, by the bits from
    ``above`` down to ``shift``.

    Only values in the bins found so far are looked at. With an odd number of values both positions are
    the same; if only one of them lies in a bin, the other is null there. A bin with a single value settles
    it: ``prefix`` is that value then.
    """
    none = F.lit(None).cast("long")
    if state is None:
        near = keys.select("*", F.lit(0).cast("long").alias("of"), none.alias("low"), none.alias("high"))
    else:
        wanted = state.where(~F.col("found")).select(*(F.col(g).alias(f"{g}_of") for g in groups), F.col("prefix").alias("of"), "low", "high")
        same = F.shiftright("key", above) == F.col("of")
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"{g}_of"))
        near = keys.join(wanted, same)
    bins = near.groupBy(*groups, "of", F.shiftright("key", shift).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most"), F.max("low").alias("low"), F.max("high").alias("high")
    )
    part = Window.partitionBy(*groups, "of")
    bins = bins.withColumn("upto", F.sum("n").over(part.orderBy("bin")))
    if state is None:
        size = F.sum("n").over(part)
        bins = bins.withColumn("size", size).withColumns({"low": F.expr("(size - 1) div 2"), "high": F.expr("size div 2")})
    below = F.col("upto") - F.col("n")
    here = {c: F.when((F.col(c) >= below) & (F.col(c) < F.col("upto")), F.col(c) - below) for c in ("low", "high")}
    settled = F.col("least") == F.col("most")
    found = bins.select(
        *groups, F.when(settled, F.col("least")).otherwise(F.col("bin")).alias("prefix"), *(v.alias(c) for c, v in here.items()), settled.alias("found")
    ).where("low IS NOT NULL OR high IS NOT NULL")
    return found if state is None else found.unionByName(state.where("found"))
