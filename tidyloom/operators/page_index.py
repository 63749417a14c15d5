"""A sorted copy with the place of every part, so that a page reads the part it lies in.

The copy is written by one range-partitioned sort, one file a part; the bounds, one row per part, tell where
each starts. Any page of it then opens the files it overlaps, two as a rule at most, and in
these the row groups with its rows. All pages follow the total order of ``access.page``.

The copy shows the result as it was when written. Without rows every page is empty. Equal rows have
places next to each other, which stay as they were written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidyloom.errors import RecipeError
from tidyloom.model import HIDDEN, col
from tidyloom.operators.access import MAX_PAGE, PLACE, _total_order
from tidyloom.plans.frame import Frame
from tidyloom.sources.seen_files import PATH, scan

_ROWS, _BOUNDS = "rows", "bounds"
FIRST, LEAST, COUNT = HIDDEN + "first", HIDDEN + "least", HIDDEN + "count"


def build(frame: Frame, path: str) -> None:
    """Write the sorted copy and its bounds below ``path``."""
    if not frame.order:
        raise RecipeError("Paging needs a row order.")
    spark = frame.df.sparkSession
    ordered = frame.df.orderBy(*_total_order(frame)).withColumn(PLACE, F.monotonically_increasing_id())
    # A part is one file: its numbers follow each other without a gap.
    ordered.select(*map(col, frame.schema.names), col(PLACE)).write.option("maxRecordsPerFile", 0).parquet(f"{path}/{_ROWS}")
    parts = spark.read.parquet(f"{path}/{_ROWS}").groupBy(F.col("_metadata.file_path").alias(PATH)).agg(
        F.min(PLACE).alias(LEAST), F.count(F.lit(1)).alias(COUNT)
    )
    # One row per part.
    before = Window.orderBy(LEAST).rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn(FIRST, F.coalesce(F.sum(COUNT).over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/{_BOUNDS}")


def page(spark: SparkSession, path: str, number: int = 1, size: int = 100) -> DataFrame:
    """One page of the copy, in its order."""
    if not 1 <= size <= MAX_PAGE:
        raise RecipeError(f"A page holds 1 to {MAX_PAGE} rows.")
    start = max(number - 1, 0) * size
    bounds = spark.read.parquet(f"{path}/{_BOUNDS}")
    # No more parts than the page has rows.
    parts = bounds.where((F.col(FIRST) < start + size) & (F.col(FIRST) + F.col(COUNT) > start)).collect()
    rows = scan(spark, f"{path}/{_ROWS}", bounds.where(F.col(PATH).isin([p[PATH] for p in parts])))
    wanted = F.lit(False)
    for p in parts:
        least = p[LEAST] + max(start - p[FIRST], 0)
        wanted = wanted | col(PLACE).between(least, p[LEAST] + min(start + size - p[FIRST], p[COUNT]) - 1)
    names = [c for c in rows.columns if not c.startswith(HIDDEN)]
    return rows.where(wanted).orderBy(col(PLACE)).select(*map(col, names))


def total_rows(spark: SparkSession, path: str) -> DataFrame:
    """Number of rows of the copy, one row, from its bounds."""
    return spark.read.parquet(f"{path}/{_BOUNDS}").agg(F.coalesce(F.sum(COUNT), F.lit(0)).alias("total_rows"))
