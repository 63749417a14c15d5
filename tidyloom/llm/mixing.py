"""Mix sources to target weights by capped water-filling, in DataFrame functions only.

A source may be read ``epochs`` times at most. Sources whose share exceeds that are
clamped and the excess is shared among the others by weight, until none is above. Every
document is then taken a whole number of times, and the fraction that is left is filled
by taking some documents once more: first in a seeded order, as long as they fit; then what
is left from the shortest document on, until none fits; then the shortest of the rest,
if that comes nearer. So a source misses its target by half of its shortest document left over, at most.

Equal rows are one place with a number of rows. A place that fits in part gives as many of
its rows as fit, so repeats neither block the fill nor jump over the target. Rows are numbered
only in such places, three a source at most, and apart for each task that reads them.

Defined cases: null is a source of its own, the last; a null text has no words and is
taken as often as its source's documents are as a whole; of equal rows any may be the ones taken
once more; an empty table gives an empty mix. Columns of the input with the names of the results are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.llm.common import before, running, saved, whole, word_count

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = 17

BIG = "decimal(38,0)"
#: Place of a document in its source's seeded order.
PLACE = ("__hash", "__id", "size")


def measured(docs: DataFrame, seed: int, key: str, text: str) -> DataFrame:
    """Add ``size`` in words and the seeded place of every row."""
    token = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.encode(whole(text), "UTF-8")))
    return docs.withColumns({"size": word_count(text), "__hash": F.md5(F.encode(token, "UTF-8")), "__id": F.col(key)}).withColumn(
        "__part", F.substring("__hash", 1, 3)
    )


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """Number sources by code point, null last, without one task that sees them all."""
    ordered = sources.withColumns({"__none": F.col(name).isNull()})
    dealt = saved(ordered.repartitionByRange("__none", name).withColumn("__range", F.spark_partition_id()))
    # One row per range of the sort: as many as shuffle partitions.
    firsts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__every", F.lit(0)).select(
        "__range", F.coalesce(F.sum("__n").over(before(["__every"], ["__range"])), F.lit(0)).alias("__first")
    )
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__none", name)) - 1
    return dealt.withColumn("__own", own).join(F.broadcast(firsts), "__range").withColumn(
        "__rank", (F.col("__first") + F.col("__own")).cast("long")
    ).drop("__range", "__own", "__first", "__none")


def water_level(sources: DataFrame) -> tuple[int, int]:
    """Words and weight left to the sources that are not clamped, over (size, weight, cap).

    A round clamps every source whose cap is below its share of what is left; each is one
    aggregate to a single row. Sums are exact, so reruns agree.
    """
    total = sources.agg(F.sum(F.col("size").cast(BIG)), F.sum("__weight")).first()
    left, weight = int(total[0] or 0), int(total[1] or 0)
    while True:
        clamped = F.col("__cap").cast(BIG) * F.lit(weight).cast(BIG) < F.lit(left).cast(BIG) * F.col("__weight").cast(BIG)
        row = sources.agg(
            F.sum(F.when(clamped, F.col("__cap")).cast(BIG)), F.sum(F.when(clamped, F.col("__weight"))), F.count(F.when(clamped, 1))
        ).first()
        now = int(total[0] or 0) - int(row[0] or 0), int(total[1] or 0) - int(row[1] or 0)
        # The level only rises, so a clamped source stays clamped and the loop ends.
        if now == (left, weight) or now[1] == 0:
            return now
        left, weight = now


def targets(sources: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Add ``target``, whole repetitions and the words that a fraction has to fill."""
    listed = F.array(*(F.lit(w) for w in weights))
    weighed = saved(sources.withColumns({
        "__weight": F.get(listed, (F.col("__rank") % len(weights)).cast("int")).cast("long"),
        "__cap": F.col("size") * F.lit(epochs),
    }))
    left, weight = water_level(weighed)
    if weight == 0:
        clamped, share, exact = F.lit(True), F.lit(0.0), F.lit(0).cast("long")
    else:
        poured = F.lit(left).cast(BIG) * F.col("__weight").cast(BIG)
        clamped = F.col("__cap").cast(BIG) * F.lit(weight).cast(BIG) < poured
        share = F.lit(float(left)) * F.col("__weight").cast("double") / F.lit(float(weight))
        exact = F.floor(poured / F.lit(weight).cast(BIG)).cast("long")
    aim = weighed.withColumns({
        "target": F.when(clamped, F.col("__cap").cast("double")).otherwise(share),
        "__aim": F.when(clamped, F.col("__cap")).otherwise(exact),
    })
    times = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(F.col("__aim") / F.greatest("size", F.lit(1)))).cast("long")
    return aim.withColumn("__times", times).withColumn("__need", F.col("__aim") - F.col("__times") * F.col("size")).withColumnRenamed(
        "size", "source_size"
    ).select("source", "__rank", "source_size", "target", "__times", "__need")


def _fill(places: DataFrame, state: DataFrame) -> DataFrame:
    """Take ``n`` rows of each place in seeded order as long as they fit into its source's ``need``.

    Gives (__rank, cut, some, got): the place that fits in part or not at all, how many of its rows are
    taken, and the words taken; without a cut everything fits, and a need of 0 cuts at the first place. Words are
    summed over 4096 parts of the order first; only the part in which a source is full is looked at place by place, so a hot
    source is spread over many tasks.
    """
    open_ = places.join(state.select("__rank", "need"), "__rank")
    parts = open_.groupBy("__rank", "__part").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.first("need").alias("need"))
    summed = parts.withColumn("upto", F.sum("words").over(running(["__rank"], ["__part"])))
    full = summed.where("upto > need").groupBy("__rank").agg(F.min(F.struct("__part", (F.col("upto") - F.col("words")).alias("base"))).alias("f")).select(
        "__rank", F.col("f")["__part"].alias("__part"), F.col("f")["base"].alias("base")
    )
    words = F.col("size") * F.col("n")
    upto = F.col("base") + F.sum(words).over(running(["__rank", "__part"], list(PLACE)))
    over = open_.join(full, ["__rank", "__part"]).withColumn("upto", upto).where("upto > need")
    before = F.col("upto") - words
    some = F.floor((F.col("need") - before) / F.col("size")).cast("long")
    cut = over.select("__rank", F.struct(*PLACE).alias("cut"), some.alias("some"), (before + some * F.col("size")).alias("got"))
    cut = cut.groupBy("__rank").agg(F.min(F.struct("cut", "some", "got")).alias("c")).select("__rank", "c.*")
    every = parts.groupBy("__rank").agg(F.sum("words").alias("all"))
    return every.join(cut, "__rank", "left").select("__rank", "cut", "some", F.coalesce("got", "all").alias("got"))


def _before(cut: str) -> Column:
    """Whether a place is in front of a cut; all are, if there is none."""
    return F.col(cut).isNull() | F.coalesce(F.struct(*PLACE) < F.col(cut), F.lit(False))


def _at(cut: str) -> Column:
    return F.coalesce(F.struct(*PLACE) == F.col(cut), F.lit(False))


def _first_fit() -> Column:
    return (F.col("__need") > 0) & (F.col("size") > 0) & _before("__cut1")


def _second_fit() -> Column:
    """Whether a place that the first pass left is taken as a whole from the shortest on."""
    short = F.col("__level").isNull() | (F.col("size") < F.col("__level")) | ((F.col("size") == F.col("__level")) & _before("__cut2"))
    return (F.col("__need2") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("__need2")) & short


def _left() -> Column:
    """Rows of a place that the first pass leaves."""
    return F.when(_first_fit(), 0).otherwise(F.col("n") - F.when((F.col("__need") > 0) & _at("__cut1"), F.col("__some1")).otherwise(0))


def _added() -> Column:
    """Rows of a place that the second pass takes."""
    level = (F.col("__need2") > 0) & (F.col("size") == F.col("__level")) & _at("__cut2")
    return F.when(_second_fit(), F.col("left")).when(level, F.col("__some2")).otherwise(0)


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED,
         key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """One row per source: its target, whole repetitions and the cuts of its fraction; and the places taken in part.

    The second table has the source's rank, the place and ``allowed``, the rows of it that are taken once more.
    """
    rows = measured(docs, seed, key, text).select(F.col(source).alias("source"), "__part", *PLACE)
    places = saved(rows.groupBy("source", "__part", *PLACE).agg(F.count(F.lit(1)).alias("n")))
    sources = places.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"))
    state = saved(targets(ranked(sources, "source"), weights, epochs))
    ranks = state.select(F.col("source").alias("__s"), "__rank")
    places = places.where("size > 0").join(ranks, F.col("source").eqNullSafe(F.col("__s"))).select("__rank", "__part", *PLACE, "n")

    found = _fill(places, state.withColumnRenamed("__need", "need").where("need > 0")).select(
        "__rank", F.col("cut").alias("__cut1"), F.col("some").alias("__some1"), "got")
    state = saved(state.join(found, "__rank", "left").withColumn("__need2", F.col("__need") - F.coalesce("got", F.lit(0))).drop("got"))

    # What is left, from the shortest on: the size at which the source is full, then the seeded order within it.
    left = places.join(state, "__rank").withColumn("left", _left()).where((F.col("left") > 0) & (F.col("size") <= F.col("__need2")))
    sizes = left.groupBy("__rank", "size").agg((F.sum("left") * F.col("size")).alias("words"), F.first("__need2").alias("need"))
    summed = sizes.withColumn("upto", F.sum("words").over(running(["__rank"], ["size"])))
    within = F.col("upto") <= F.col("need")
    levels = saved(summed.groupBy("__rank").agg(F.min(F.when(~within, F.col("size"))).alias("__level"), F.coalesce(F.sum(F.when(within, F.col("words"))), F.lit(0)).alias("got")))
    state = saved(state.join(levels, "__rank", "left").withColumn("need", F.col("__need2") - F.coalesce("got", F.lit(0))).drop("got"))
    level = left.join(levels.select("__rank", "__level"), "__rank").where("size = __level")
    # Also where shorter ones reach the target to the word: without a cut all of this size would be taken.
    found = _fill(level.select("__rank", "__part", *PLACE, F.col("left").alias("n")), state.where("__level IS NOT NULL").select("__rank", "need")).select(
        "__rank", F.col("cut").alias("__cut2"), F.col("some").alias("__some2"), "got")
    state = saved(state.join(found, "__rank", "left").withColumn("__open", F.col("need") - F.coalesce("got", F.lit(0))).drop("got", "need"))

    # The shortest document left comes nearer to the target if under twice what is open.
    rest = places.join(state, "__rank").withColumn("left", _left()).withColumn("added", _added())
    last = rest.where((F.col("__open") > 0) & (F.col("left") > F.col("added")) & (F.col("size") < 2 * F.col("__open")))
    last = last.groupBy("__rank").agg(F.min(F.struct("size", "__hash", "__id")).alias("l")).select(
        "__rank", F.struct(*(F.col("l")[c].alias(c) for c in PLACE)).alias("__last"))
    state = saved(state.join(last, "__rank", "left"))
    cut = places.join(state, "__rank").where(_special()).withColumn("left", _left()).withColumn("added", _added())
    allowed = F.col("n") - F.col("left") + F.col("added") + _at("__last").cast("long")
    return state, saved(cut.select("__rank", *PLACE, allowed.alias("__allowed")))


def _special() -> Column:
    """Places of which only some rows may be taken."""
    return (F.col("size") > 0) & (_at("__cut1") | _at("__cut2") | _at("__last"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Number the rows of every place from 1 as ``__no``; each task numbers its own and starts after those before it."""
    dealt = saved(rows.withColumn("__task", F.spark_partition_id()))
    place = ["__rank", *PLACE]
    counts = dealt.groupBy(*place, "__task").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select(*place, "__task", F.coalesce(F.sum("__n").over(before(place, ["__task"])), F.lit(0)).alias("__first"))
    first = first.withColumnsRenamed({c: f"{c}_of" for c in (*place, "__task")})
    own = F.row_number().over(Window.partitionBy(*place, "__task").orderBy("__hash"))
    same = F.lit(True)
    for c in (*place, "__task"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    return dealt.withColumn("__own", own).join(first, same).withColumn("__no", F.col("__own") + F.col("__first"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED,
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All columns, with size, source_size, target, copies and taken (words, repeats counted)."""
    state, cut = plan(docs, weights, epochs, seed, key, text, source)
    state = state.withColumnRenamed("source", "__source")
    rows = measured(docs.drop("source_size", "target", "copies", "taken"), seed, key, text)
    joined = rows.join(state, F.col(source).eqNullSafe(F.col("__source")))
    extra = _first_fit() | _second_fit()
    whole_ = joined.where(~_special()).withColumn("copies", F.col("__times") + extra.cast("long"))
    names = {c: f"{c}_at" for c in ("__rank", *PLACE)}
    some = cut.withColumnsRenamed(names)
    numbered = _numbered(joined.where(_special()).select(*whole_.drop("copies").columns))
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    part = numbered.join(some, same).withColumn("copies", F.col("__times") + (F.col("__no") <= F.col("__allowed")).cast("long"))
    result = whole_.unionByName(part.select(*whole_.columns)).withColumn("taken", F.col("copies") * F.col("size"))
    return result.drop(*(c for c in result.columns if c.startswith("__")))
