"""Logical column types and the dataset schema carried beside a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.errors import RecipeError

TEXT, NUMBER, CURRENCY, DATE, BOOLEAN, EMPTY = "text", "number", "currency", "date", "boolean", "empty"
LOGICAL_TYPES = (TEXT, NUMBER, CURRENCY, DATE, BOOLEAN, EMPTY)

# Prefix of the columns the engine adds for row order; users never see them.
HIDDEN = "__tl_"
METADATA_KEY = "logical_type"
MAX_COLUMNS = 512


def col(name: str) -> Column:
    """Column by exact name, whatever dots, quotes or spaces it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    data_type: T.DataType | None = None

    @property
    def is_numeric(self) -> bool:
        return self.type in (NUMBER, CURRENCY)

    @property
    def is_text(self) -> bool:
        return self.type in (TEXT, EMPTY)

    @property
    def is_date(self) -> bool:
        return self.type == DATE

    @property
    def is_integral(self) -> bool:
        return isinstance(self.data_type, T.IntegralType)

    def col(self) -> Column:
        return col(self.name)


@dataclass(frozen=True)
class DatasetSchema:
    """The closed list of columns a recipe may name, in order."""

    columns: tuple[ColumnSpec, ...]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def resolve(self, name: str) -> ColumnSpec:
        for column in self.columns:
            if column.name == name:
                return column
        raise RecipeError(f'Column "{name}" does not exist in this dataset.')

    def resolve_all(self, names: Iterable[str] | None) -> list[ColumnSpec]:
        """The named columns, each once; all columns when no name is given."""
        wanted = list(dict.fromkeys(names or self.names))
        return [self.resolve(name) for name in wanted]

    def subset(self, names: Iterable[str]) -> DatasetSchema:
        return DatasetSchema(tuple(self.resolve_all(names)))

    def renamed(self, mapping: dict[str, str]) -> DatasetSchema:
        return DatasetSchema(tuple(replace(c, name=mapping.get(c.name, c.name)) for c in self.columns))

    def with_type(self, name: str, logical: str, data_type: T.DataType) -> DatasetSchema:
        changed = ColumnSpec(name, logical, data_type)
        return DatasetSchema(tuple(changed if c.name == name else c for c in self.columns))


def logical_type(field: T.StructField) -> str:
    """Logical type of a field: the one stored at ingestion, else from its Spark type."""
    stored = (field.metadata or {}).get(METADATA_KEY)
    if stored in LOGICAL_TYPES:
        return stored
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(kind, T.NumericType):
        # Imported here: the header hints live with type inference.
        from tidyloom.operators.infer import header_suggests_currency

        return CURRENCY if header_suggests_currency(field.name) else NUMBER
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, T.NullType):
        return EMPTY
    raise RecipeError(f'Column "{field.name}" has type {kind.simpleString()}; only flat columns are supported.')


def schema_of(df: DataFrame, types: dict[str, str] | None = None) -> DatasetSchema:
    """Schema of a DataFrame; ``types`` overrides logical types by column name."""
    fields = [f for f in df.schema.fields if not f.name.startswith(HIDDEN)]
    if len(fields) > MAX_COLUMNS:
        raise RecipeError(f"A dataset may have at most {MAX_COLUMNS} columns.")
    types = types or {}
    return DatasetSchema(
        tuple(ColumnSpec(f.name, types.get(f.name) or logical_type(f), f.dataType) for f in fields)
    )


def with_logical_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Store logical types in the field metadata, which Parquet keeps."""
    return df.select(
        [
            col(f.name).alias(f.name, metadata={**(f.metadata or {}), METADATA_KEY: types[f.name]})
            if f.name in types
            else col(f.name)
            for f in df.schema.fields
        ]
    )
