"""One recipe on many datasets, and many recipes against many datasets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.errors import SourceError
from tidyloom.functions.text import strip
from tidyloom.model import CURRENCY, EMPTY, HIDDEN, MAX_COLUMNS, NUMBER, with_logical_types
from tidyloom.operators import metrics as metric_ops
from tidyloom.operators.filters import MAX_DEPTH
from tidyloom.operators.infer import Strategy, coerce, convert_by, infer_files
from tidyloom.plans import recipe as recipes
from tidyloom.plans.frame import SOURCE, Frame, OrderKey, by_source, frame_of
from tidyloom.session import written
from tidyloom.sources.records import Records, columns_of, name_refused, read_records

SALTS = 16


# --- the same recipe on many files -----------------------------------------

def reapply(
    spark: SparkSession, recipe: dict, *paths: str, types: dict[str, str] | None = None
) -> Frame:
    """Run a recipe on every file as if it were alone: duplicates count per file."""
    df = by_source(spark.read.parquet(*paths))
    return recipes.run(df, recipe, types=types, group_by=[SOURCE])


def reapply_text(
    spark: SparkSession, recipe: dict, *paths: str, strategies: dict[str, Strategy] | None = None,
    columns: list[str] | None = None, types: dict[str, str] | None = None, refused: str = "raise", **limits
) -> Frame:
    """The same for folders of delimited text in any mix of encodings, separators, headers and ways to write cells.

    Every file is read by its own layout and converted by types inferred from its own cells, so one
    may write ``1.234,56`` and ``31/12/2024`` where another writes ``1234.56`` and ``2024-12-31``.
    A file that lacks a column has it empty. ``strategies`` of an earlier file fix the conversion of
    all instead. ``columns`` keeps these only; by default all columns of all files appear.

    A column has one type in the result: that of ``types``, else the one all files agree on,
    empty columns apart. Files that disagree raise an error that names them, unless ``refused`` is "skip".
    """
    return reapply_records(read_records(spark, *paths, refused=refused, **limits), recipe, strategies, columns, types, refused)


def reapply_records(
    found: Records, recipe: dict, strategies: dict[str, Strategy] | None = None, columns: list[str] | None = None,
    types: dict[str, str] | None = None, refused: str = "raise",
) -> Frame:
    """The same for records that are read already."""
    if strategies is not None:
        names = columns or list(strategies)
        raw = columns_of(found, names)
        typed = coerce(_hidden(raw), {n: strategies[n] for n in names})
    else:
        typed = typed_records(found, columns, types, refused)
    frame = frame_of(typed, group_by=[SOURCE])
    return recipes.apply_steps(replace(frame, anchor=(OrderKey(BLOCK), OrderKey(ROW))), recipe)


BLOCK, ROW = HIDDEN + "block", HIDDEN + "row"


def _hidden(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed({"source": SOURCE, "block": BLOCK, "row": ROW})


def _kinds(strategies: DataFrame, columns: list[str] | None) -> DataFrame:
    """Per column: its first position, the kinds it has in files, empty ones apart; money and numbers are one kind."""
    wanted = strategies if columns is None else strategies.where(F.col("name").isin(columns))
    kind = F.when(F.col("type") == CURRENCY, NUMBER).when(F.col("type") != EMPTY, F.col("type"))
    return wanted.groupBy("name").agg(
        F.min("position").alias("position"), F.min(kind).alias("least"), F.max(kind).alias("most"),
        F.max((F.col("type") == CURRENCY).cast("int")).alias("money"),
    )


def typed_records(
    found: Records, columns: list[str] | None = None, types: dict[str, str] | None = None, refused: str = "raise", max_columns: int = MAX_COLUMNS
) -> DataFrame:
    """Typed columns of records, each file converted by its own strategies, with its name and row order in hidden columns."""
    strategies = written(infer_files(found.rows, found.headers))
    # One row per column of the result.
    rows = _kinds(strategies, columns).orderBy("position", "name").limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise SourceError(f"The files have more than {max_columns} different columns; name those to keep.")
    kinds = {r["name"]: (CURRENCY if r["money"] else NUMBER) if r["least"] == NUMBER else r["least"] or EMPTY for r in rows} | (types or {})
    names = columns if columns is not None else [r["name"] for r in rows]
    kinds = {n: kinds.get(n, EMPTY) for n in names}
    split = [r["name"] for r in rows if r["least"] != r["most"] and r["name"] not in (types or {})]
    keep = found.headers
    if split:
        keep = _agreeing(found.headers, strategies, split, kinds, refused)
    entry = F.struct("name", F.struct("position", "type", "decimal", "date_format").alias("how"))
    told = strategies.groupBy("source").agg(F.map_from_entries(F.collect_list(entry)).alias("told")).join(keep.select("source"), "source")
    joined = found.rows.join(told, "source")
    how = lambda n: F.try_element_at("told", F.lit(n))
    values = [strip(F.get("cells", how(n)["position"])) for n in names]
    placed = joined.select(
        F.col("source").alias(SOURCE), F.col("block").alias(BLOCK), F.col("row").alias(ROW),
        *(v.alias(f"v{i}") for i, v in enumerate(values)), *(how(n).alias(f"h{i}") for i, n in enumerate(names)),
    )
    typed = placed.select(*(convert_by(F.col(f"v{i}"), kinds[n], F.col(f"h{i}")).alias(n) for i, n in enumerate(names)), SOURCE, BLOCK, ROW)
    return with_logical_types(typed, kinds)


def _agreeing(headers: DataFrame, strategies: DataFrame, split: list[str], kinds: dict[str, str], refused: str) -> DataFrame:
    """Files whose columns have the kind that most files give them; of equals the first in the alphabet."""
    kind = F.when(F.col("type") == CURRENCY, NUMBER).otherwise(F.col("type"))
    seen = strategies.where(F.col("name").isin(split) & (F.col("type") != EMPTY)).select("source", "name", kind.alias("kind"))
    counted = seen.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("name").agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("best"))
    if refused != "skip":
        bad = seen.join(best, "name").where("kind <> best")
        name_refused(bad.select(F.col("source").alias("path"), F.format_string('column "%s" is %s, in most files %s', "name", "kind", "best").alias("reason")))
    # One row per column that files disagree on.
    for row in best.collect():
        money = strategies.where((F.col("name") == row["name"]) & (F.col("type") == CURRENCY)).limit(1).count()
        kinds[row["name"]] = (CURRENCY if money else NUMBER) if row["best"] == NUMBER else row["best"]
    return headers.join(seen.join(best, "name").where("kind <> best").select("source").distinct(), "source", "left_anti")


def metrics_by_source(frame: Frame, recipe: dict) -> DataFrame:
    """Metrics of a recipe for each file, in one aggregate."""
    return metric_ops.compute(frame, recipe.get("metrics") or [])


# --- many recipes against many datasets ------------------------------------

def _tree_schema(depth: int) -> T.StructType:
    """Filter tree as JSON, down to a number of levels."""
    fields = [T.StructField("type", T.StringType()), T.StructField("column", T.StringType())]
    if depth > 1:
        fields.append(T.StructField("children", T.ArrayType(_tree_schema(depth - 1))))
    return T.StructType(fields)


def _tree_columns(node: Column, depth: int) -> Column:
    """Names in a tree: its own, if it is a condition, and those of its children."""
    own = F.when(node["type"] == "condition", F.array(node["column"])).otherwise(F.array().cast("array<string>"))
    if depth == 1:
        return own
    below = F.flatten(F.transform(node["children"], lambda child: _tree_columns(child, depth - 1)))
    return F.concat(own, F.coalesce(below, F.array().cast("array<string>")))


def _recipe_schema() -> T.StructType:
    text, texts = T.StringType(), T.ArrayType(T.StringType())
    entry = lambda name: T.ArrayType(T.StructType([T.StructField(name, text)]))
    step = T.StructType([
        T.StructField("kind", text), T.StructField("column", text), T.StructField("columns", texts),
        T.StructField("by", entry("column")), T.StructField("mapping", entry("from")), T.StructField("filter", _tree_schema(MAX_DEPTH)),
    ])
    return T.StructType([T.StructField("steps", T.ArrayType(step)), T.StructField("metrics", entry("column"))])


def recipe_columns(definitions: DataFrame) -> DataFrame:
    """Columns named by recipes stored as JSON: ``(recipe_id, definition)`` to ``(recipe_id, column)``.

    Definitions that are missing or no JSON name nothing; ``refused_recipes`` lists them.
    """
    none = F.array().cast("array<string>")
    read = definitions.where(_reason().isNull()).select("recipe_id", F.from_json("definition", _recipe_schema()).alias("r"))

    def named(step: Column) -> Column:
        of_kind = lambda kinds, names: F.when(step["kind"].isin(*kinds), F.coalesce(names, none)).otherwise(none)
        return F.concat(
            of_kind(["filter"], _tree_columns(step["filter"], MAX_DEPTH)), of_kind(recipes.COLUMN_LISTS, step["columns"]),
            of_kind(recipes.ONE_COLUMN, F.array(step["column"])), of_kind(["rename_columns"], step["mapping"]["from"]),
            of_kind(["sort"], step["by"]["column"]),
        )

    steps = F.coalesce(F.flatten(F.transform("r.steps", named)), none)
    every = F.array_distinct(F.array_compact(F.concat(steps, F.coalesce(F.col("r.metrics.column"), none))))
    return read.select("recipe_id", F.explode(every).alias("column"))


def _reason() -> Column:
    return F.when(F.col("definition").isNull(), "definition is missing").when(
        F.try_parse_json("definition").isNull(), "definition is not valid JSON"
    )


def refused_recipes(definitions: DataFrame) -> DataFrame:
    """Stored recipes that cannot be read, with the reason."""
    return definitions.select("recipe_id", _reason().alias("reason")).where("reason IS NOT NULL")


def _numbered(wanted: DataFrame) -> DataFrame:
    """Dictionary of the names that recipes need: column, word of 64 names, bit in it.

    Numbers leave gaps between parts, which costs words but no task that sees all names.
    It is written, so that a repeated task gives no name another number.
    """
    number = F.monotonically_increasing_id()
    names = wanted.where(F.col("column").isNotNull()).select("column").distinct().orderBy("column").select("column", number.alias("number"))
    return written(names.select("column", F.shiftright("number", 6).alias("word"), F.col("number").bitwiseAND(F.lit(63)).cast("int").alias("bit")))


def _bitmaps(listed: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """One row per key: its names as bits of words; names out of the dictionary are left out."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    words = listed.join(names, "column").groupBy(key, "word").agg(F.bit_or(bit).alias("bits"))
    return words.groupBy(key).agg(F.collect_list(F.struct("word", "bits")).alias("words"))


def _lacking(pairs: DataFrame, wanted: DataFrame, present: DataFrame, names: DataFrame) -> DataFrame:
    """Every pair with the words of names it lacks: those of the recipe and not of the dataset.

    A recipe and a dataset meet once, with 16 bytes for up to 64 names. A recipe that most
    datasets use is repeated under a few salts.
    """
    salted = _bitmaps(wanted, names, "recipe_id").select(
        F.col("recipe_id").alias("of_recipe"), F.col("words").alias("needed"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt")
    )
    held = _bitmaps(present, names, "dataset_id").select(F.col("dataset_id").alias("of_dataset"), F.map_from_entries("words").alias("there"))
    dealt = pairs.select("recipe_id", "dataset_id", F.pmod(F.xxhash64("dataset_id"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = dealt.join(salted, (F.col("recipe_id") == F.col("of_recipe")) & (F.col("salt") == F.col("of_salt")), "left").join(
        held, F.col("dataset_id") == F.col("of_dataset"), "left"
    )
    there = lambda word: F.coalesce(F.try_element_at("there", word), F.lit(0).cast("long"))
    lacking = F.transform("needed", lambda w: F.struct(w["word"].alias("word"), w["bits"].bitwiseAND(F.bitwise_not(there(w["word"]))).alias("bits")))
    none = F.array().cast("array<struct<word:bigint,bits:bigint>>")
    return joined.select("recipe_id", "dataset_id", F.coalesce(lacking, none).alias("lacking"))


def missing_columns(pairs: DataFrame, wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Columns a recipe needs and a dataset lacks.

    ``pairs`` says which recipe is to run on which dataset; ``wanted`` is
    ``(recipe_id, column)``, ``present`` is ``(dataset_id, column)``.
    """
    names = _numbered(wanted)
    words = _lacking(pairs, wanted, present, names).select("recipe_id", "dataset_id", F.inline("lacking")).where("bits <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return words.select("recipe_id", "dataset_id", "word", F.explode(bits).alias("bit")).join(names, ["word", "bit"]).select("recipe_id", "dataset_id", "column")


def compatibility(pairs: DataFrame, wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Every pair with the number of columns it lacks; zero means the recipe fits."""
    counted = F.aggregate("lacking", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"]))
    return _lacking(pairs, wanted, present, _numbered(wanted)).select("recipe_id", "dataset_id", counted.alias("missing"))


def resolve_names(requests: DataFrame, present: DataFrame, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """Find the column a loosely written name means.

    ``requests`` holds ``dataset_id`` and ``name`` among its columns; ``present``
    is ``(dataset_id, position, column)``. Case does not matter. Without an exact
    match, the one column that contains the name or is contained in it is taken;
    if there is none or more than one, ``resolved`` is null.

    Each dataset's names travel as one array, which the limit on columns keeps
    short, so a request meets its dataset once instead of once per column. The
    arrays are repeated under a few salts, so that a dataset which most requests
    ask for is still spread over many tasks.
    """
    entry = F.struct("position", "column")
    listed = present.groupBy("dataset_id").agg(F.array_sort(F.collect_set(entry)).alias("entries"))
    listed = listed.select(
        F.col("dataset_id").alias("of_dataset"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"),
        # A dataset beyond the limit resolves nothing; it must not end the job for the others.
        F.when(F.size("entries") <= max_columns, F.transform("entries", lambda e: e["column"])).alias("names"),
    )
    needle = F.lower(strip(F.col("name")))
    asked = requests.withColumn("needle", needle).withColumn("salt", F.pmod(F.hash(*requests.columns), F.lit(SALTS)))
    wanted = F.col("needle")
    exact = F.try_element_at(F.filter("names", lambda c: F.lower(c) == wanted), F.lit(-1))
    close = F.filter("names", lambda c: F.contains(F.lower(c), wanted) | F.contains(wanted, F.lower(c)))
    same = (F.col("dataset_id") == F.col("of_dataset")) & (F.col("salt") == F.col("of_salt"))
    joined = asked.join(listed, same, "left")
    found = joined.withColumns({"close": close, "exact": exact})
    resolved = F.coalesce(F.col("exact"), F.when(F.size("close") == 1, F.get("close", F.lit(0))))
    return found.withColumn("resolved", resolved).select(*requests.columns, "resolved")
