"""Profile of a dataset: statistics per column, duplicates, frequent values.

Every cell becomes one row of (column position, value). Counting equal ones, with
the combine in each map task, gives distinct counts and all statistics from one
shuffle, without a copy of the whole row for each distinct count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.errors import RecipeError
from tidyloom.functions.cells import SLOT, cells, position_of
from tidyloom.functions.text import display_text
from tidyloom.model import BOOLEAN, CURRENCY, NUMBER, TEXT, DatasetSchema, schema_of

# Which columns list frequent values, and how many of each.
TOP_MAX_DISTINCT = 60
TOP_LIMIT = 15
TOP_MAX_COLUMNS = 40
# Which columns describe a category worth showing.
CATEGORY_MIN, CATEGORY_MAX, CATEGORY_COLUMNS = 2, 15, 4

# Longest text that is counted as it is, and what the digest of a longer one starts with.
KEY_BYTES = 64
DIGEST = "\u0001sha256:"
_FINITE_FIELDS = ("min", "max", "sum", "avg")


def _by_kind(schema: DatasetSchema) -> dict[str, dict[int, Column]]:
    """Values of the columns by position, apart for numbers, dates and everything else."""
    kinds: dict[str, dict[int, Column]] = {"number": {}, "moment": {}, "text": {}}
    for position, column in enumerate(schema.columns):
        if column.is_numeric:
            kinds["number"][position] = column.col().cast("double")
        elif column.is_date:
            kinds["moment"][position] = column.col().cast("timestamp_ntz")
        else:
            kinds["text"][position] = _short(display_text(column).cast("string"))
    return {kind: values for kind, values in kinds.items() if values}


def _short(text: Column) -> Column:
    """The text itself, or its digest where it is long: no long text travels as a key."""
    return F.when(F.octet_length(text) > KEY_BYTES, F.concat(F.lit(DIGEST), F.sha2(text, 256))).otherwise(text)


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _value_counts(df: DataFrame, values: dict[int, Column]) -> DataFrame:
    """Number of times each value occurs in each column: slot, value, n."""
    return cells(df, values).groupBy(SLOT, "value").agg(F.count(F.lit(1)).alias("n"))


def _column_table(schema: DatasetSchema) -> list[tuple[int, str, str]]:
    return [(i, c.name, c.type) for i, c in enumerate(schema.columns)]


def _described(stats: DataFrame, schema: DatasetSchema) -> DataFrame:
    """Add name and type to rows that hold a column position."""
    names = F.array(*(F.lit(name) for _, name, _ in _column_table(schema)))
    kinds = F.array(*(F.lit(kind) for _, _, kind in _column_table(schema)))
    return stats.withColumns({"name": F.get(names, "position"), "type": F.get(kinds, "position")})


def _exact(df: DataFrame, kind: str, values: dict[int, Column]) -> DataFrame:
    n, value = F.col("n"), F.col("value")
    filled = value.isNotNull()
    sums = {}
    if kind == "number":
        sums = {"sum": F.sum(value * n), "avg": F.sum(value * n) / F.sum(F.when(filled, n))}
    return _value_counts(df, values).groupBy(SLOT).agg(
        F.sum(F.when(filled, 0).otherwise(n)).alias("nullCount"),
        F.count(value).alias("distinctCount"),
        *_ranges(kind, value, sums),
    )


def _approximate(df: DataFrame, kind: str, values: dict[int, Column]) -> DataFrame:
    """The same from sketches: nothing but one row per column and task is shuffled."""
    value = F.col("value")
    sums = {"sum": F.sum(value), "avg": F.avg(value)} if kind == "number" else {}
    return cells(df, values).groupBy(SLOT).agg(
        F.count_if(value.isNull()).alias("nullCount"),
        F.approx_count_distinct(value, 0.02).alias("distinctCount"),
        *_ranges(kind, value, sums),
    )


def _ranges(kind: str, value: Column, sums: dict[str, Column]) -> list[Column]:
    """Aggregates every kind of column reports, null where they do not apply."""
    number, moment = kind == "number", kind == "moment"
    least, most = F.min(value), F.max(value)
    no_number, no_moment = F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
    return [
        (least if number else no_number).alias("min"),
        (most if number else no_number).alias("max"),
        sums.get("sum", no_number).alias("sum"),
        sums.get("avg", no_number).alias("avg"),
        (least if moment else no_moment).alias("minDate"),
        (most if moment else no_moment).alias("maxDate"),
    ]


def column_statistics(
    df: DataFrame, types: dict[str, str] | None = None, approximate: bool = False
) -> DataFrame:
    """One row per column: nulls, distinct values, range, sum and mean."""
    schema = schema_of(df, types)
    measure = _approximate if approximate else _exact
    parts = [measure(df, kind, values) for kind, values in _by_kind(schema).items()]
    stats = reduce(DataFrame.unionByName, parts).withColumn("position", position_of())
    return _described(stats, schema).select(
        "position", "name", "type", F.col("nullCount").cast("long").alias("nullCount"),
        F.col("distinctCount").cast("long").alias("distinctCount"),
        *(_finite(F.col(f)).alias(f) for f in _FINITE_FIELDS), "minDate", "maxDate",
    )


def top_values(
    df: DataFrame, types: dict[str, str] | None = None, limit: int | None = TOP_LIMIT,
    max_distinct: int | None = TOP_MAX_DISTINCT, max_columns: int | None = TOP_MAX_COLUMNS,
) -> DataFrame:
    """Most frequent values of the columns with few distinct ones: name, rank, value, count.

    ``limit`` values of columns with at most ``max_distinct`` ones, of the first
    ``max_columns`` such columns; None leaves a limit out.
    """
    schema = schema_of(df, types)
    tops = _top_rows(df, schema, limit, max_distinct, max_columns)
    return _described(tops, schema).select("name", "rank", "value", "count")


def _top_rows(df: DataFrame, schema: DatasetSchema, limit: int | None, max_distinct: int | None, max_columns: int | None) -> DataFrame:
    """Frequent values of the qualifying columns, ranked.

    The counts are those of the column statistics, so both read one shuffle. The rank
    limit runs in every task, so a column with many values sends only its top few.
    """
    texts = _by_kind(schema).get("text", {})
    listed = [i for i, c in enumerate(schema.columns) if c.type in (TEXT, BOOLEAN)]
    if not listed:
        raise RecipeError("The dataset has no text or yes/no column.")
    counts = _value_counts(df, texts)
    # Nulls rank last instead of being filtered, which would make another shuffle of it.
    order = Window.partitionBy(SLOT).orderBy(F.col("value").isNull(), F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    sizes = counts.groupBy(SLOT).agg(F.count("value").alias("distinct"))
    few = sizes.where(F.col("distinct") <= max_distinct) if max_distinct is not None else sizes
    few = few.select(position_of().alias("chosen")).where(F.col("chosen").isin(listed))
    # One row per column.
    few = F.broadcast(few.orderBy("chosen").limit(max_columns) if max_columns is not None else few)
    tops = ranked.select(position_of(), F.col("rank").cast("int").alias("rank"), "value", F.col("n").alias("count"))
    tops = tops.join(few, F.col("position") == F.col("chosen")).where(F.col("value").isNotNull()).drop("chosen")
    return _written_out(df, schema, tops, listed, limit is not None)


def _written_out(df: DataFrame, schema: DatasetSchema, tops: DataFrame, listed: list[int], few: bool) -> DataFrame:
    """Put the texts back for digests among the values shown; with ``few`` of them the texts need no shuffle."""
    is_long, sent = F.startswith("value", F.lit(DIGEST)), F.broadcast if few else (lambda small: small)
    wanted = sent(tops.where(is_long).select(F.col("position").alias("at"), F.col("value").alias("key")))
    full = {i: display_text(schema.columns[i]).cast("string") for i in listed}
    long = cells(df, full).where(F.octet_length("value") > KEY_BYTES).select(
        position_of().alias("of"), _short(F.col("value")).alias("of_key"), F.col("value").alias("text")
    )
    texts = long.join(wanted, (F.col("of") == F.col("at")) & (F.col("of_key") == F.col("key"))).groupBy("at", "key").agg(F.min("text").alias("text"))
    joined = tops.join(sent(texts), (F.col("position") == F.col("at")) & (F.col("value") == F.col("key")), "left")
    return joined.withColumn("value", F.coalesce("text", "value")).drop("at", "key", "text")


def row_counts(df: DataFrame, types: dict[str, str] | None = None, approximate: bool = False) -> DataFrame:
    """One row: rows, columns, rows with an empty cell and surplus duplicates."""
    schema = schema_of(df, types)
    incomplete = F.lit(False)
    for column in schema.columns:
        incomplete = incomplete | column.col().isNull()
    marked = df.select(row_digest(schema).alias("digest"), incomplete.alias("incomplete"))
    if approximate:
        rows = F.count(F.lit(1))
        return marked.agg(
            rows.alias("rowCount"), F.lit(len(schema.columns)).alias("columnCount"),
            F.greatest(rows - F.approx_count_distinct("digest.a", 0.01), F.lit(0)).alias("duplicateRowCount"),
            F.count_if("incomplete").alias("rowsWithEmptyCount"),
        )
    per_row = marked.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("incomplete")).alias("incomplete")
    )
    none = F.lit(0).cast("long")
    return per_row.agg(
        F.coalesce(F.sum("n"), none).alias("rowCount"),
        F.lit(len(schema.columns)).alias("columnCount"),
        F.coalesce(F.sum(F.col("n") - 1), none).alias("duplicateRowCount"),
        F.coalesce(F.sum("incomplete"), none).alias("rowsWithEmptyCount"),
    )


def row_digest(schema: DatasetSchema) -> Column:
    """128 bits of a row: two hashes over its cells and over which of them are null.

    It is what the shuffle carries instead of rows that may be hundreds of columns wide.
    Hashes take both zeros and every NaN for one value, as comparison does.
    """
    values = [c.col() for c in schema.columns]
    # Nulls leave a hash as it is, so their places are hashed as well.
    nulls = F.concat_ws("", *(F.when(v.isNull(), "1").otherwise("0") for v in values))
    return F.struct(F.xxhash64(nulls, *values).alias("a"), F.xxhash64(F.lit(DIGEST), nulls, *reversed(values)).alias("b"))


def profile(
    df: DataFrame, types: dict[str, str] | None = None, approximate: bool = False, limit: int = TOP_LIMIT,
    max_distinct: int | None = TOP_MAX_DISTINCT, max_columns: int | None = TOP_MAX_COLUMNS,
) -> DataFrame:
    """Complete profile: one row per column with its frequent values, and the row counts beside it.

    With ``approximate`` distinct values and duplicate rows come from sketches.
    """
    schema = schema_of(df, types)
    stats = column_statistics(df, types, approximate)
    if any(c.type in (TEXT, BOOLEAN) for c in schema.columns):
        entry = F.struct("rank", "value", "count")
        # A few rows for each column.
        tops = _top_rows(df, schema, limit, max_distinct, max_columns).groupBy(F.col("position").alias("p")).agg(
            F.array_sort(F.collect_list(entry)).alias("ranked")
        )
        shown = F.transform("ranked", lambda r: F.struct(r["value"].alias("value"), r["count"].alias("count")))
        stats = stats.join(F.broadcast(tops.select("p", shown.alias("topValues"))), F.col("position") == F.col("p"), "left").drop("p")
    else:
        stats = stats.withColumn("topValues", F.lit(None).cast("array<struct<value:string,count:bigint>>"))
    whole = row_counts(df, types, approximate).select(F.struct("*")).scalar()
    return stats.withColumn("dataset", whole).select(*stats.columns, "dataset.*")


# --- reports on a profile --------------------------------------------------

def primary_measure(stats: DataFrame) -> DataFrame:
    """Numeric column with the largest absolute sum; currency columns go first."""
    candidates = stats.where(F.col("type").isin(CURRENCY, NUMBER) & F.col("sum").isNotNull())
    ranked = candidates.orderBy(
        (F.col("type") == CURRENCY).desc(), F.abs("sum").desc(), F.col("position").asc()
    )
    return ranked.limit(1)


def category_shares(profiled: DataFrame) -> DataFrame:
    """Values of the columns that describe a category, each with its share of the rows."""
    chosen = (
        profiled.where(
            F.col("type").isin(TEXT, BOOLEAN)
            & (F.size("topValues") >= CATEGORY_MIN)
            & (F.col("distinctCount") <= CATEGORY_MAX)
        )
        .orderBy("distinctCount", "position")
        .limit(CATEGORY_COLUMNS)
    )
    rows = chosen.select("name", "rowCount", F.inline("topValues"))
    return rows.select("name", "value", "count", (F.col("count") / F.col("rowCount") * 100).alias("percent"))


def quality(profiled: DataFrame) -> DataFrame:
    """Shares of missing cells per column, and of duplicate and incomplete rows."""
    def share(part: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part) * 100.0, F.col("rowCount")), F.lit(0.0))

    return profiled.select(
        "position", "name", share("nullCount").alias("nullPercent"),
        share("duplicateRowCount").alias("duplicatePercent"), share("rowsWithEmptyCount").alias("emptyPercent"),
    )
