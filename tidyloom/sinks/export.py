"""Export for spreadsheet programs: local number and date style, no live formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.model import CURRENCY, ColumnSpec, col
from tidyloom.operators.metrics import Watch
from tidyloom.operators.steps import select_columns
from tidyloom.plans.frame import Frame

# First characters a spreadsheet takes for a formula, and the data
# rows one sheet can hold.
FORMULA_SIGNS = ("=", "+", "-", "@", "\t", "\r")
SHEET_ROWS = 1_048_575
BOM = "﻿"
SEPARATOR = ";"

# Labels of the summary.
SOURCE_LABEL = "Planilha de origem"
CREATED_LABEL = "Gerado em"
ROWS_LABEL = "Registros exportados"
MISSING = "--"


def neutralize(text: Column) -> Column:
    """Put an apostrophe before text that would run as a formula."""
    risky = F.substring(text, 1, 1).isin(*FORMULA_SIGNS)
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def neutralize_name(name: str) -> str:
    return "'" + name if name.startswith(FORMULA_SIGNS) else name


def decimal_text(value: Column) -> Column:
    """Two decimals after a comma, halves rounded up."""
    fixed = F.replace(value.try_cast("decimal(38,2)").cast("string"), F.lit("."), F.lit(","))
    # Beyond 36 digits, and for values that are no number, the plain form remains.
    return F.coalesce(fixed, F.lower(value.cast("string")))


def cell_text(column: ColumnSpec) -> Column:
    """Text of a cell in the exported file; null where it is empty."""
    value, kind = column.col(), column.data_type
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return decimal_text(value)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "dd/MM/yyyy")
    if isinstance(kind, T.BooleanType):
        return F.when(value, "Sim").when(~value, "Nao")
    if isinstance(kind, T.IntegralType):
        return value.cast("string")
    return neutralize(value.cast("string"))


def export_frame(frame: Frame, columns: list[str] | None = None) -> Frame:
    """Result narrowed to the chosen columns, as one more step of the recipe."""
    return select_columns(frame, {"columns": columns}) if columns else frame


def formatted(frame: Frame, columns: list[str] | None = None, ordered: bool = True, watch: Watch | None = None) -> DataFrame:
    """Result as text cells under safe names, in its order."""
    chosen = export_frame(frame, columns)
    # A watch may count columns that are not shown.
    source = frame if watch else chosen
    df = source.df.orderBy(*source.order_by()) if ordered and source.order else source.df
    df = watch.on(df) if watch else df
    return df.select(*(cell_text(c).alias(neutralize_name(c.name)) for c in chosen.schema.columns))


def write_delimited(
    frame: Frame, path: str, columns: list[str] | None = None,
    rows_per_file: int = SHEET_ROWS, mode: str = "errorifexists", ordered: bool = True, watch: Watch | None = None,
) -> None:
    """Write the result as delimited text that spreadsheet programs open directly.

    All tasks write at once; no file holds more rows than a sheet, and none is lost.
    The names of the files follow the order of the rows, unless ``ordered`` is
    off, which saves the sort. A ``watch`` on the frame sees all rows on their way.
    """
    rows = formatted(frame, columns, ordered, watch)
    first, *others = rows.columns
    # Every file starts with the mark that tells programs the encoding.
    marked = rows.select(col(first).alias(BOM + first), *map(col, others))
    (
        marked.write.mode(mode)
        .option("sep", SEPARATOR).option("header", "true").option("encoding", "UTF-8")
        .option("quote", '"').option("escape", '"')
        .option("nullValue", "").option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def summary(frame: Frame, metrics: DataFrame, source: str, created: str | None = None, rows: int | None = None) -> DataFrame:
    """What was exported and what the metrics gave: position, label, text, value.

    Metrics that could not be computed are left out. ``rows`` is the number of exported rows, if
    a watch of the export has counted them.
    """
    exported = frame.df.agg(F.count(F.lit(1)).alias("n")) if rows is None else frame.df.sparkSession.createDataFrame([(rows,)], "n long")
    now = F.lit(created) if created else F.date_format(F.current_timestamp(), "dd/MM/yyyy HH:mm")
    lines = F.array(
        _line(0, F.lit(SOURCE_LABEL), neutralize(F.lit(source)), F.lit(None)),
        _line(1, F.lit(CREATED_LABEL), now, F.lit(None)),
        _line(2, F.lit(ROWS_LABEL), F.col("n").cast("string"), F.col("n")),
    )
    head = exported.select(F.inline(lines))
    money = F.concat(F.lit("R$ "), decimal_text(F.col("value")))
    text = F.when(F.col("value").isNull(), F.lit(MISSING)).when(F.col("format") == CURRENCY, money)
    body = metrics.where(F.col("error").isNull()).select(
        (F.col("position") + 3).alias("position"),
        neutralize(F.col("label")).alias("label"),
        text.otherwise(decimal_text(F.col("value"))).alias("text"),
        F.col("value").cast("double").alias("value"),
    )
    return head.unionByName(body)


def _line(position: int, label: Column, text: Column, value: Column) -> Column:
    return F.struct(
        F.lit(position).alias("position"), label.alias("label"), text.alias("text"),
        value.cast("double").alias("value"),
    )
