"""Shards by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A key walks through ever larger shard numbers, led by a linear congruential generator
that starts from the key. Its shard is the last number below the shard count, so one
more shard takes rows only into itself and no ring table is kept.

Defined cases: a null key counts as 0; a null text has no bytes and the checksum 0;
equal rows share their shard and get different slots; an empty table gives an empty
result. Columns of the input with the names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.llm.common import before, saved, whole

# Fixed values of the published method: the multiplier of the generator and its range.
MULTIPLIER = 2862933555777941757
RANGE = float(1 << 31)

LOW = 0xFFFFFFFF
#: Parts into which the rows of all shards are dealt for numbering, at least.
PARTS = 1 << 16
#: A part is numbered by tasks if it has so many rows, and so many times the mean of all parts beyond.
LEAST_HEAVY, TIMES_HEAVY = 1000, 4


def _times(x: Column, factor: int) -> Column:
    """``x * factor`` to a multiple of 2**32 and below 2**49, for 32-bit numbers."""
    return x * F.lit(factor & 0xFFFF) + F.shiftleft((x * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The next state of the generator: MULTIPLIER times the state plus 1, modulo 2**64.

    Halves of 32 bits keep every product below 2**63, as ANSI arithmetic asks.
    """
    upper, lower = MULTIPLIER >> 32, MULTIPLIER & LOW
    second = low * F.lit(lower >> 16)
    first = low * F.lit(lower & 0xFFFF) + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carried = F.shiftright(second, 16) + F.shiftright(first, 32)
    return (carried + _times(low, upper) + _times(high, lower)).bitwiseAND(F.lit(LOW)), first.bitwiseAND(F.lit(LOW))


def jump(key: Column, shards: int) -> Column:
    """Struct of ``shard`` among ``shards`` and ``grown`` among one more, for a long key.

    One walk gives both: only its last step can have reached the added shard.
    """
    key = F.coalesce(key, F.lit(0)).cast("long")
    high, low = _next(F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(LOW)))
    start = F.struct(high.alias("h"), low.alias("l"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("was"))

    def step(state: Column, _: Column) -> Column:
        reached = F.floor((state["at"] + 1) * (F.lit(RANGE) / (F.shiftright(state["h"], 1) + 1).cast("double")))
        more_high, more_low = _next(state["h"], state["l"])
        moved = F.struct(more_high.alias("h"), more_low.alias("l"), reached.alias("at"), state["at"].alias("was"))
        return F.when(reached <= shards, moved).otherwise(state)

    def end(state: Column) -> Column:
        stays = F.when(state["at"] < shards, state["at"]).otherwise(state["was"])
        return F.struct(stays.cast("int").alias("shard"), state["at"].cast("int").alias("grown"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, end)


def assign(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (with one shard more) to every row."""
    number = F.col(key) if dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    return docs.withColumn("__jump", jump(number, shards)).withColumns(
        {"shard": F.col("__jump")["shard"], "grown_shard": F.col("__jump")["grown"]}
    ).drop("__jump")


def slots(sharded: DataFrame, shards: int, order: list[str]) -> DataFrame:
    """Number the rows of every shard from 0 without gaps, as ``slot``.

    A shard is dealt into parts by a hash of ``order``; parts are numbered on their own
    and start after the rows of the parts before, so no task sees a whole shard. Equal rows
    share a part; a part with far more rows than most is kept as a table of its own and
    numbered apart for each task that reads it. Equal rows may change places.
    """
    parts = max(1, PARTS // shards)
    dealt = sharded.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    place = ["shard", "__part"]
    # At most max(PARTS, shards) rows of three numbers: bounded by parameters, not by data.
    counts = saved(dealt.groupBy(*place).agg(F.count(F.lit(1)).alias("__n")))
    first = F.broadcast(counts.select(
        *place, F.coalesce(F.sum("__n").over(before(["shard"], ["__part"])), F.lit(0)).alias("__first")
    ))
    mean = counts.agg(F.avg("__n")).first()[0] or 0.0
    heavy = F.broadcast(counts.where(F.col("__n") > LEAST_HEAVY + TIMES_HEAVY * mean).select(*place))
    own = F.row_number().over(Window.partitionBy(*place).orderBy(*order)) - 1
    light = dealt.join(heavy, place, "left_anti").withColumn("__own", own)

    large = saved(dealt.join(heavy, place, "left_semi").withColumn("__task", F.spark_partition_id()))
    tasks = large.groupBy(*place, "__task").agg(F.count(F.lit(1)).alias("__n")).select(
        *place, "__task", F.coalesce(F.sum("__n").over(before(place, ["__task"])), F.lit(0)).alias("__earlier")
    )
    own = F.row_number().over(Window.partitionBy(*place, "__task").orderBy(*order)) - 1
    split = large.withColumn("__own", own).join(tasks, [*place, "__task"]).withColumn("__own", F.col("__own") + F.col("__earlier"))
    numbered = light.unionByName(split.select(*light.columns))
    return numbered.join(first, place).withColumn("slot", F.col("__first") + F.col("__own")).drop("__part", "__own", "__first")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``size`` (bytes of the text and 8) and ``text_crc32``."""
    return docs.withColumns({
        "size": F.octet_length(whole(text)).cast("long") + F.lit(8),
        "text_crc32": F.crc32(F.encode(whole(text), "UTF-8")),
    })


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns, with size, text_crc32, shard, grown_shard, slot and law."""
    placed = slots(assign(measured(docs, text), shards, key), shards, [key, "text_crc32", "size"])
    return placed.withColumn("law", F.lit("key"))
