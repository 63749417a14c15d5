"""A wide table turned into one row per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = "slot"


def cells(df: DataFrame, values: dict[int, Column], keep: list[Column] | None = None) -> DataFrame:
    """Rows ``(slot, value)`` for columns of one type, after the ``keep`` columns.

    Only the columns named are read, and the rows are produced inside the
    generated code of the scan stage. Group by the slot, then ask ``position_of``.
    """
    kept = keep or []
    wide = df.select(*kept, *(value.alias(f"v{position}") for position, value in values.items()))
    return wide.unpivot(wide.columns[: len(kept)], [f"v{p}" for p in values], SLOT, "value")


def position_of() -> Column:
    """Position of the column a slot stands for; cheap once slots are grouped."""
    return F.expr(f"substring({SLOT}, 2)").cast("int").alias("position")
