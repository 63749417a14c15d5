"""A DataFrame on its way through a recipe, with schema and row order beside it.

A shuffle destroys the physical order of rows, so order is kept as data: the
anchor columns tell the original position, the order keys the latest sort.
Both are applied only where rows are paged or written.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.errors import RecipeError
from tidyloom.model import HIDDEN, DatasetSchema, col, schema_of

SOURCE = HIDDEN + "source"


@dataclass(frozen=True)
class OrderKey:
    column: str
    descending: bool = False

    def expression(self) -> Column:
        """Empty cells come last in both directions."""
        value = col(self.column)
        return value.desc_nulls_last() if self.descending else value.asc_nulls_last()


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    schema: DatasetSchema
    base: DataFrame
    # Position of a row in its source, ascending.
    anchor: tuple[OrderKey, ...] = ()
    # Keys of the last sort step.
    sorting: tuple[OrderKey, ...] = ()
    # Columns that keep datasets apart when one recipe runs over many of them:
    # hidden copies, which no step can touch, and the names they are shown under.
    group: tuple[str, ...] = ()
    group_names: tuple[str, ...] = ()

    @property
    def hidden(self) -> list[str]:
        """Columns that travel along beside the visible ones, each once."""
        keys = [k.column for k in (*self.anchor, *self.sorting)]
        names = self.schema.names
        return [n for n in dict.fromkeys((*self.group, *keys)) if n not in names]

    @property
    def order(self) -> list[OrderKey]:
        """Complete order: the latest sort, ties in original order."""
        seen = {k.column for k in self.sorting}
        return [*self.sorting, *(k for k in self.anchor if k.column not in seen)]

    def order_by(self) -> list[Column]:
        return [key.expression() for key in self.order]

    def where(self, test: Column) -> Frame:
        return replace(self, df=self.df.where(test))

    def project(self, columns: list[Column], schema: DatasetSchema) -> Frame:
        """New visible columns; the hidden ones follow."""
        return replace(self, df=self.df.select(*columns, *map(col, self.hidden)), schema=schema)

    def replace_column(self, name: str, value: Column, logical: str) -> Frame:
        """Put a new value into a column, keeping a copy if the row order needs the old one."""
        frame = self.freeze([name])
        out = frame.project(
            [value.alias(c) if c == name else col(c) for c in frame.schema.names], frame.schema
        )
        kind = out.df.schema[name].dataType
        return replace(out, schema=frame.schema.with_type(name, logical, kind))

    def freeze(self, names: list[str]) -> Frame:
        """Copy the order keys among ``names`` into hidden columns before they change."""
        touched = [k.column for k in self.order if k.column in names and k.column in self.schema.names]
        if not touched:
            return self
        taken = sum(c.startswith(HIDDEN + "key") for c in self.df.columns)
        copies = {n: f"{HIDDEN}key{taken + i}_{n}" for i, n in enumerate(dict.fromkeys(touched))}

        def moved(keys):
            return tuple(replace(k, column=copies.get(k.column, k.column)) for k in keys)

        return replace(
            self,
            df=self.df.select(*map(col, self.df.columns), *(col(n).alias(c) for n, c in copies.items())),
            anchor=moved(self.anchor),
            sorting=moved(self.sorting),
        )

    def visible(self) -> DataFrame:
        """The result as the user sees it, in no particular order."""
        return self.df.select(*map(col, self.schema.names))

    def ordered(self) -> DataFrame:
        """The result in its order; one range-partitioned sort."""
        df = self.df.orderBy(*self.order_by()) if self.order else self.df
        return df.select(*map(col, self.schema.names))


def frame_of(
    df: DataFrame,
    types: dict[str, str] | None = None,
    order_by: list[str] | None = None,
    group_by: list[str] | None = None,
    anchored: bool = False,
) -> Frame:
    """Start of a recipe on a DataFrame.

    ``order_by`` names columns that give the rows their order; together they
    should be unique, or rows that tie may change places. With ``anchored``
    the position in the source files is used instead; the DataFrame must then be
    a plain file read.
    """
    for name in (*(order_by or ()), *(group_by or ())):
        if name not in df.columns:
            raise RecipeError(f'Column "{name}" does not exist in this dataset.')
    groups = {f"{HIDDEN}group{i}": name for i, name in enumerate(group_by or ())}
    keys = [OrderKey(name) for name in order_by or ()]
    visible = [c for c in df.columns if not c.startswith(HIDDEN)]
    schema = schema_of(df.select(*map(col, visible)), types)
    if anchored and not keys:
        from tidyloom.sources.tables import anchor_columns

        anchors = anchor_columns(df)
        df = df.select(*map(col, df.columns), *(c.alias(n) for n, c in anchors.items()))
        keys = [OrderKey(name) for name in anchors]
    if groups:
        df = df.select(*map(col, df.columns), *(col(n).alias(g) for g, n in groups.items()))
    names = tuple(name.removeprefix(HIDDEN) for name in groups.values())
    return Frame(df, schema, base=df, anchor=tuple(keys), group=tuple(groups), group_names=names)


def by_source(df: DataFrame) -> DataFrame:
    """Add the source file of every row; each file then counts as one dataset."""
    return df.select(*map(col, df.columns), F.col("_metadata.file_path").alias(SOURCE))
