"""The ten cleaning steps; each takes a frame and returns the next one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidyloom.errors import RecipeError
from tidyloom.functions.literals import coerce, java_pattern, literal
from tidyloom.functions.parsing import iso_moment, to_double, to_moment
from tidyloom.functions.text import SPACES, display_text, fold, is_blank, trim_spaces
from tidyloom.model import BOOLEAN, DATE, HIDDEN, NUMBER, TEXT, ColumnSpec, col
from tidyloom.operators.filters import predicate
from tidyloom.plans.frame import Frame, OrderKey

# Words a cast reads as yes and as no.
CAST_TRUE = ("true", "sim", "s", "1", "yes")
CAST_FALSE = ("false", "nao", "não", "n", "0", "no")


def filter_rows(frame: Frame, step: dict) -> Frame:
    return frame.where(predicate(step["filter"], frame.schema))


def drop_duplicates(frame: Frame, step: dict) -> Frame:
    """Keep the first or last row of each key, or only keys that occur once.

    Whole keys never meet in one task: the row-number limit is applied in every
    map task before the shuffle, and the count is combined there as well.
    """
    keys = [c.name for c in frame.schema.resolve_all(step.get("columns"))]
    keys = [*frame.group, *keys]
    keep = step.get("keep", "first")
    if keep == "none":
        return _singletons(frame, keys)
    if keep not in ("first", "last"):
        raise RecipeError(f'Unknown choice of duplicates to keep: "{keep}".')
    if not frame.anchor:
        raise RecipeError("Keeping the first or last duplicate needs a row order.")
    position = [col(k.column).desc() if keep == "last" else col(k.column).asc() for k in frame.anchor]
    number = HIDDEN + "rank"
    ranked = frame.df.withColumn(
        number, F.row_number().over(Window.partitionBy(*map(col, keys)).orderBy(*position))
    )
    kept = ranked.where(col(number) == 1).drop(number)
    return replace(frame, df=kept)


def _singletons(frame: Frame, keys: list[str]) -> Frame:
    copies = {name: f"{HIDDEN}u_{name}" for name in keys}
    rows = frame.df.groupBy(*(col(n).alias(c) for n, c in copies.items())).agg(
        F.count(F.lit(1)).alias(HIDDEN + "n"),
        F.first(F.struct(*map(col, frame.df.columns))).alias(HIDDEN + "row_data"),
    )
    alone = rows.where(col(HIDDEN + "n") == 1)
    row = col(HIDDEN + "row_data")
    return replace(frame, df=alone.select(*(row.getField(n).alias(n) for n in frame.df.columns)))


def drop_empty_rows(frame: Frame, step: dict) -> Frame:
    mode = step.get("mode", "all")
    if mode not in ("all", "any"):
        raise RecipeError(f'Unknown mode for empty rows: "{mode}".')
    blanks = [is_blank(c) for c in frame.schema.resolve_all(step.get("columns"))]
    return frame.where(~reduce(and_ if mode == "all" else or_, blanks))


def select_columns(frame: Frame, step: dict) -> Frame:
    schema = frame.schema.subset(step["columns"])
    left_out = [n for n in frame.schema.names if n not in schema.names]
    return frame.freeze(left_out).project([c.col() for c in schema.columns], schema)


def drop_columns(frame: Frame, step: dict) -> Frame:
    removed = {c.name for c in frame.schema.resolve_all(step["columns"])}
    remaining = [n for n in frame.schema.names if n not in removed]
    if not remaining:
        raise RecipeError("The recipe would remove every column.")
    return select_columns(frame, {"columns": remaining})


def rename_columns(frame: Frame, step: dict) -> Frame:
    """All renames at once, so that names can be swapped."""
    mapping = {}
    for entry in step["mapping"]:
        origin, target = frame.schema.resolve(entry["from"]).name, str(entry["to"]).strip()
        if not target:
            raise RecipeError(f'The new name for the column "{origin}" is empty.')
        if target.startswith(HIDDEN):
            raise RecipeError(f'The name "{target}" is reserved.')
        mapping[origin] = target
    schema = frame.schema.renamed(mapping)
    repeated = sorted(name for name, n in Counter(schema.names).items() if n > 1)
    if repeated:
        raise RecipeError(f"Renaming would give several columns the same name: {', '.join(repeated)}.")
    frozen = frame.freeze(list(mapping))
    return frozen.project(
        [c.col().alias(mapping.get(c.name, c.name)) for c in frame.schema.columns], schema
    )


def sort_rows(frame: Frame, step: dict) -> Frame:
    """Remember the order; it is applied where rows are paged or written."""
    keys = tuple(
        OrderKey(frame.schema.resolve(entry["column"]).name, entry.get("direction") == "desc")
        for entry in step["by"]
    )
    kept = [k.column for k in frame.anchor]
    stale = [k.column for k in frame.sorting if k.column.startswith(HIDDEN) and k.column not in kept]
    first_mention = {}
    for key in keys:
        first_mention.setdefault(key.column, key)
    return replace(frame, df=frame.df.drop(*stale), sorting=tuple(first_mention.values()))


def cast_column(frame: Frame, step: dict) -> Frame:
    column, target = frame.schema.resolve(step["column"]), step["to"]
    if target == NUMBER:
        return frame.replace_column(column.name, _as_number(column), NUMBER)
    if target == DATE:
        return frame.replace_column(column.name, _as_date(column, step.get("format")), DATE)
    if target == BOOLEAN:
        return frame.replace_column(column.name, _as_boolean(column), BOOLEAN)
    if target == TEXT:
        return frame.replace_column(column.name, display_text(column), TEXT)
    raise RecipeError(f'A column cannot be cast to "{target}".')


def _as_number(column: ColumnSpec) -> Column:
    if column.is_numeric:
        return column.col()
    text = display_text(column)
    for found, new in (("R$", ""), (".", ""), (",", ".")):
        text = F.replace(text, F.lit(found), F.lit(new))
    return to_double(text)


def _as_date(column: ColumnSpec, pattern: str | None) -> Column:
    if pattern:
        return to_moment(display_text(column), java_pattern(pattern))
    if column.is_date:
        return column.col().cast("timestamp_ntz")
    return iso_moment(display_text(column))


def _as_boolean(column: ColumnSpec) -> Column:
    if column.type == BOOLEAN:
        return column.col()
    text = fold(display_text(column))
    return F.when(text.isin(*CAST_TRUE), True).when(text.isin(*CAST_FALSE), False)


def replace_values(frame: Frame, step: dict) -> Frame:
    column = frame.schema.resolve(step["column"])
    text = display_text(column)
    pairs = [(str(e["from"]), str(e["to"])) for e in step["replacements"]]
    mode = step.get("mode", "exact")
    if mode == "exact":
        finals = chained(pairs)
        if finals:
            table = F.create_map(*(F.lit(v) for pair in finals.items() for v in pair))
            text = F.coalesce(F.try_element_at(table, trim_spaces(text)), text)
    elif mode == "contains":
        for found, new in pairs:
            text = F.replace(text, F.lit(found), F.lit(new))
    else:
        raise RecipeError(f'Unknown replacement mode: "{mode}".')
    return frame.replace_column(column.name, text, TEXT)


def chained(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Final value of every cell that some pair matches, after all pairs ran in order.

    Resolving the chain here leaves one lookup per row, however long it is.
    """
    finals = {}
    for start in dict.fromkeys(found.strip(SPACES) for found, _ in pairs):
        value = start
        for found, new in pairs:
            if value.strip(SPACES) == found.strip(SPACES):
                value = new
        finals[start] = value
    return finals


def fill_empty(frame: Frame, step: dict) -> Frame:
    column = frame.schema.resolve(step["column"])
    value = coerce(step["value"], column)
    if value is None:
        raise RecipeError(f'The fill value for "{column.name}" is missing.')
    filler = literal(value, column)
    if column.is_text:
        text = column.col().cast("string")
        filled = F.when(is_blank(column), filler).otherwise(text)
    else:
        filled = F.coalesce(column.col(), filler)
    return frame.replace_column(column.name, filled, TEXT if column.is_text else column.type)


STEPS: dict[str, Callable[[Frame, dict], Frame]] = {
    "filter": filter_rows,
    "drop_duplicates": drop_duplicates,
    "drop_empty_rows": drop_empty_rows,
    "select_columns": select_columns,
    "drop_columns": drop_columns,
    "rename_columns": rename_columns,
    "sort": sort_rows,
    "cast": cast_column,
    "replace_values": replace_values,
    "fill_empty": fill_empty,
}

# Steps that look at one row at a time, so that they also run on a stream.
STATELESS = tuple(kind for kind in STEPS if kind not in ("drop_duplicates", "sort"))
