"""Reading a result: pages, free-text search, the values of a column, previews."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.errors import RecipeError
from tidyloom.functions.text import display_text
from tidyloom.model import HIDDEN, DatasetSchema, col, schema_of
from tidyloom.operators import metrics as metric_ops
from tidyloom.plans.frame import Frame
from tidyloom.session import cut_lineage

MAX_PAGE = 500
MAX_VALUES = 200
# Pages of the largest size up to which tasks keep all rows up to the page.
TOP_PAGES = 10
PLACE = HIDDEN + "place"
# Anchors that are unique by themselves.
SOURCE_PLACES = (HIDDEN + "row", HIDDEN + "position")


def search(frame: Frame, text: str | None, wildcards: bool = False) -> Frame:
    """Keep rows whose columns, joined by a space, contain the text.

    The text is literal; with ``wildcards`` the signs ``%`` and ``_`` match
    anything, as in SQL.
    """
    if not text:
        return frame
    cells = [F.coalesce(display_text(c), F.lit("")) for c in frame.schema.columns]
    haystack = F.lower(F.concat_ws(" ", *cells))
    if wildcards:
        pattern = "%" + text.replace("\\", "\\\\") + "%"
        return frame.where(F.like(haystack, F.lower(F.lit(pattern))))
    return frame.where(F.contains(haystack, F.lower(F.lit(text))))


def _total_order(frame: Frame) -> list[Column]:
    """Order keys and, against ties, all other columns: only equal rows may change places."""
    keys = [k.column for k in frame.order]
    rest = [] if any(k in SOURCE_PLACES for k in keys) else [n for n in frame.schema.names if n not in keys]
    return [*frame.order_by(), *(col(n).asc_nulls_last() for n in rest)]


def page(frame: Frame, number: int = 1, size: int = 100) -> DataFrame:
    """One page of the result in its order, the same whichever way it is found."""
    if not 1 <= size <= MAX_PAGE:
        raise RecipeError(f"A page holds 1 to {MAX_PAGE} rows.")
    if not frame.order:
        raise RecipeError("Paging needs a row order.")
    start = max(number - 1, 0) * size
    if start + size <= TOP_PAGES * MAX_PAGE:
        top = frame.df.orderBy(*_total_order(frame)).offset(start).limit(size)
        return top.select(*map(col, frame.schema.names))
    # Further on, no task may hold all rows up to the page.
    found = numbered(frame).where(col(PLACE).between(start, start + size - 1))
    return found.orderBy(col(PLACE)).select(*map(col, frame.schema.names))


def numbered(frame: Frame) -> DataFrame:
    """All rows of the result with their place in its order, from 0, as column ``PLACE``.

    Rows go through one range-partitioned sort, and each part starts after the rows
    of the parts before it: one small row per part is all that leaves the executors.
    """
    if not frame.order:
        raise RecipeError("Paging needs a row order.")
    sorted_ = frame.df.orderBy(*_total_order(frame)).withColumn(PLACE, F.monotonically_increasing_id())
    ranked = cut_lineage(sorted_.select(*map(col, frame.schema.names), col(PLACE)))
    # The upper bits of the running number are the part, the lower 33 the row in it.
    part, row = F.shiftright(col(PLACE), 33), col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))
    firsts, passed = [], 0
    for number, rows in sorted((r[0], r[1]) for r in ranked.groupBy(part.alias("part")).count().collect()):
        firsts += [F.lit(number), F.lit(passed)]
        passed += rows
    first = F.create_map(*firsts)[part] if firsts else F.lit(0)
    return ranked.withColumn(PLACE, (first + row).cast("long"))


def total_rows(frame: Frame) -> DataFrame:
    """Number of result rows, one row; independent of any page."""
    return frame.df.agg(F.count(F.lit(1)).alias("total_rows"))


def column_values(
    df: DataFrame, column: str, text: str | None = None, limit: int = 50, types: dict[str, str] | None = None
) -> DataFrame:
    """Most frequent values of a column of the base data, as text with their counts."""
    if not 1 <= limit <= MAX_VALUES:
        raise RecipeError(f"Between 1 and {MAX_VALUES} values can be listed.")
    spec = schema_of(df, types).resolve(column)
    # Equal cells are combined before they are turned into text and searched.
    counted = df.where(spec.col().isNotNull()).groupBy(spec.col()).agg(F.count(F.lit(1)).alias(HIDDEN + "n"))
    counted = counted.select(display_text(spec).alias("value"), col(HIDDEN + "n").alias("count"))
    if text:
        counted = counted.where(F.contains(F.lower("value"), F.lower(F.lit(text))))
    return counted.orderBy(F.desc("count"), F.asc("value")).limit(limit)


def wire_values(df: DataFrame) -> DataFrame:
    """Values fit for JSON: exact decimals, ISO dates, no NaN or infinity, bytes as text."""
    return df.select(*(_wire(f).alias(f.name) for f in df.schema.fields))


def _wire(field: T.StructField) -> Column:
    value, kind = col(field.name), field.dataType
    if isinstance(kind, T.DecimalType):
        return value.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.date_format(value, "SSSSSS")
        return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
    if isinstance(kind, T.BinaryType):
        return F.decode(value, "UTF-8")
    return value


@dataclass(frozen=True)
class Preview:
    """A page with the metrics of the whole result."""

    schema: DatasetSchema
    rows: DataFrame
    metrics: DataFrame
    total_rows: DataFrame
    input_rows: DataFrame


def preview(
    frame: Frame, metrics: list[dict] | None = None, number: int = 1, size: int = 100,
    text: str | None = None, wildcards: bool = False,
) -> Preview:
    """Page, totals and metrics of a recipe result.

    The search narrows the page and its total; the metrics stay those of the
    whole result.
    """
    found = search(frame, text, wildcards)
    return Preview(
        schema=frame.schema,
        rows=wire_values(page(found, number, size)),
        metrics=metric_ops.compute(replace(frame, sorting=()), metrics or []),
        total_rows=total_rows(found),
        input_rows=frame.base.agg(F.count(F.lit(1)).alias("input_rows")),
    )
