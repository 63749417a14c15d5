"""Column types inferred from text, and the conversion that follows from them.

All columns are looked at together: each cell becomes one row of
(column position, text), and one aggregate counts what the cells look like.
The decision is an expression over such a row of counts, so many files can be decided
apart from each other in the same aggregate, grouped by file and column.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.errors import SourceError
from tidyloom.functions.cells import SLOT, cells, position_of
from tidyloom.functions.parsing import to_double, to_moment
from tidyloom.functions.text import WHITESPACE, strip
from tidyloom.model import (
    BOOLEAN, CURRENCY, DATE, EMPTY, HIDDEN, MAX_COLUMNS, NUMBER, TEXT, col, with_logical_types,
)

# Share of cells that must match, widest safe whole number.
THRESHOLD = 0.90
MAX_SAFE_DIGITS = 15

# Texts that stand for a missing cell.
NULL_TOKENS = (
    "", "-", "--", "n/a", "na", "nao informado", "não informado", "null", "nulo", "#n/d", "#n/a",
)
# Texts read as yes and as no at ingestion.
TRUE_TOKENS = ("sim", "s", "true", "verdadeiro", "v", "1", "yes", "y")
FALSE_TOKENS = ("nao", "não", "n", "false", "falso", "f", "0", "no")
# Words in a header that suggest money.
CURRENCY_HINTS = (
    "valor", "preco", "preço", "total", "custo", "saldo", "montante", "receita",
    "despesa", "pagamento", "salario", "salário", "tarifa", "juros", "desconto",
    "credito", "crédito", "debito", "débito", "amount", "price", "cost", "revenue",
    "r$", "brl", "usd", "faturamento", "ticket",
)
# Shapes of numbers with a decimal comma and with a decimal point,
# of codes with a leading zero, and what is dropped before reading a number.
COMMA_NUMBER = r"^-?\d{1,3}(?:\.\d{3})*,\d+$|^-?\d+,\d+$"
POINT_NUMBER = r"^-?\d{1,3}(?:,\d{3})*(?:\.\d+)?$|^-?\d+(?:\.\d+)?$"
LEADING_ZERO = r"^-?0\d"
MONEY_WORDS = ("BRL", "USD", "R$")
MONEY_SIGNS = "$€£"
LOOSE_MONEY_MARKS = r"(?i)[R$€£\s\p{Z}]|BRL|USD"
ACCOUNTING = r"^\((.+)\)$"
# A whole number that could have points between its thousands.
GROUPED_WHOLE = r"^-?\d{1,3}(?:\.\d{3})*$|^-?\d+$"
# What every number and every date below starts out as.
NUMBER_LIKE = r"^-?\d[\d.,]*$"
DATE_LIKE = r"^\d{1,4}[/.-]\d{1,2}[/.-]\d{2,4}(?:[ T][\d:]+)?$"
# Date formats in the order they are tried, each with the shape
# that a cell must have before it is worth parsing.
DATE_FORMATS = (
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy H:m:s", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d/M/yyyy H:m", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("d/M/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
)

_CELL = "value"


@dataclass(frozen=True)
class Strategy:
    """How a column is converted."""

    type: str
    decimal: str | None = None
    date_format: str | None = None
    native: bool = False


def stored(strategies: dict[str, Strategy]) -> str:
    """Strategies as JSON, to convert later files as the first one was."""
    return json.dumps({name: asdict(strategy) for name, strategy in strategies.items()}, ensure_ascii=False)


def restored(text: str) -> dict[str, Strategy]:
    return {name: Strategy(**fields) for name, fields in json.loads(text).items()}


def header_suggests_currency(header: str) -> bool:
    lowered = header.strip().lower()
    return any(hint in lowered for hint in CURRENCY_HINTS)


# --- inference -------------------------------------------------------------

def infer(df: DataFrame, compat: bool = False, max_columns: int = MAX_COLUMNS) -> dict[str, Strategy]:
    """Strategy of every column.

    Every cell is looked at, in one aggregate. ``compat`` counts a cell such as
    ``1,234`` both as a comma and as a point number, and overlooks any letter R in a
    number, which the conversion does not.
    """
    fields = [f for f in df.schema.fields if not f.name.startswith(HIDDEN)]
    if not fields:
        raise SourceError("The dataset has no columns.")
    if len(fields) > max_columns:
        raise SourceError(f"A dataset may have at most {max_columns} columns.")
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    found = _text_strategies(df, texts, compat) if texts else {}
    return {f.name: found.get(f.name, Strategy(EMPTY)) if f.name in texts else _native(f) for f in fields}


def _native(field: T.StructField) -> Strategy:
    kind = field.dataType
    if isinstance(kind, T.NumericType):
        return Strategy(CURRENCY if header_suggests_currency(field.name) else NUMBER, native=True)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Strategy(DATE, native=True)
    if isinstance(kind, T.BooleanType):
        return Strategy(BOOLEAN, native=True)
    if isinstance(kind, T.NullType):
        return Strategy(EMPTY)
    raise SourceError(f'Column "{field.name}" has type {kind.simpleString()}; only flat columns are supported.')


def _text_strategies(df: DataFrame, names: list[str], compat: bool) -> dict[str, Strategy]:
    found = cells(df, {i: col(name) for i, name in enumerate(names)})
    features = _features(found.where(F.col(_CELL).isNotNull()), compat).withColumn("position", position_of())
    header = F.get(F.array(*map(F.lit, names)), F.col("position"))
    # One row per column.
    rows = features.select("position", _decision(header, compat).alias("s")).collect()
    return {names[r["position"]]: Strategy(**r["s"].asDict()) for r in rows}


#: Strategy of a column of a file, as a type.
STRATEGY = "struct<type: string, decimal: string, date_format: string>"


def infer_files(rows: DataFrame, headers: DataFrame, compat: bool = False) -> DataFrame:
    """``(source, position, name, type, decimal, date_format)`` for every column of every file.

    ``rows`` is ``(source, cells)``, ``headers`` ``(source, names)``. Every file is decided by its own
    cells, in one aggregate for all; positions count from 0, and a column without cells is empty.
    """
    found = rows.select("source", F.posexplode("cells").alias("position", _CELL)).where(F.col(_CELL).isNotNull())
    keys = ["source", "position"]
    features = _features(found, compat, keys)
    named = headers.select("source", F.posexplode("names").alias("position", "name"))
    decided = named.join(features, keys, "left").withColumn("s", _decision(F.col("name"), compat))
    return decided.select(*keys, "name", "s.*")


def _features(found: DataFrame, compat: bool, keys: list[str] | tuple[str, ...] = (SLOT,)) -> DataFrame:
    """Counts per column of what its cells look like.

    Each stage prepares what the next one uses more than once; the two cheap
    shape tests spare most cells the detailed ones.
    """
    stripped = found.select(*keys, strip(F.col(_CELL)).alias("v"))
    kept = stripped.select(*keys, "v", F.lower("v").alias("low")).where(~F.col("low").isin(*NULL_TOKENS))
    bare = F.regexp_replace("v", LOOSE_MONEY_MARKS, "") if compat else _without_money_marks(F.col("v"))
    cleaned = kept.select(*keys, "v", "low", bare.alias("bare"), F.col("v").rlike(DATE_LIKE).alias("datelike"))
    shaped = cleaned.select(*keys, "v", "low", "datelike", _signed(F.col("bare")).alias("n"))
    shaped = shaped.withColumn("numeric", F.col("n").rlike(NUMBER_LIKE))
    number, low, numeric = F.col("n"), F.col("low"), F.col("numeric")
    filled = number != ""
    comma, point = numeric & number.rlike(COMMA_NUMBER), numeric & number.rlike(POINT_NUMBER)
    whole = F.substring_index(F.substring_index(F.ltrim(number, F.lit("-")), ",", 1), ".", 1)
    code = number.rlike(LEADING_ZERO) | (F.length(whole) > MAX_SAFE_DIGITS)
    looked = shaped.select(
        *keys, "v", "low", "datelike", filled.alias("filled"), comma.alias("comma"), point.alias("point"),
        (filled & code).alias("code"), number.rlike(GROUPED_WHOLE).alias("grouped"),
    )
    dates = [
        F.count_if(
            F.when(F.col("datelike") & F.col("v").rlike(shape), to_moment(F.col("v"), pattern)).isNotNull()
        ).alias(f"date{i}")
        for i, (pattern, shape) in enumerate(DATE_FORMATS)
    ]
    comma, point = F.col("comma"), F.col("point")
    return looked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(low.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias("truths"),
        F.count_if(low.isin("0", "1")).alias("bits"),
        F.count_if("filled").alias("numbers"),
        F.count_if("code").alias("codes"),
        F.count_if(comma).alias("comma"),
        F.count_if(point).alias("point"),
        F.count_if(comma & point).alias("both"),
        F.count_if(point & ~comma & ~F.col("grouped")).alias("point_only"),
        F.count_if(F.contains("v", F.lit("$")) | F.contains("v", F.lit("€"))).alias("symbols"),
        *dates,
    )


def _decision(header: Column, compat: bool) -> Column:
    """Strategy as a struct, from the counts of a column and its header."""
    filled, numbers, comma, point, both = (F.col(c) for c in ("cells", "numbers", "comma", "point", "both"))
    matching = comma + point - (F.lit(0) if compat else both)
    # Cells that only make sense with a decimal point overrule ambiguous ones.
    readable = F.lit(True) if compat else (comma > both) | (F.col("point_only") == 0)
    decimal = F.when((numbers > 0) & (F.col("codes") == 0), F.when(
        (comma > 0) & readable & (matching / numbers >= THRESHOLD), ","
    ).when(point / numbers >= THRESHOLD, "."))
    lowered = F.lower(strip(header))
    hinted = F.exists(F.array(*map(F.lit, CURRENCY_HINTS)), lambda hint: F.contains(lowered, hint))
    none = F.lit(None).cast("string")

    def strategy(kind: str | Column, decimal: Column = none, date_format: Column = none) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("type"), decimal.alias("decimal"), date_format.alias("date_format"))

    money = F.when(hinted | (F.col("symbols") > 0), CURRENCY).otherwise(NUMBER)
    chosen = F.when(F.coalesce(filled, F.lit(0)) == 0, strategy(EMPTY))
    chosen = chosen.when((F.col("truths") == filled) & (F.col("bits") < filled), strategy(BOOLEAN))
    chosen = chosen.when(decimal.isNotNull(), strategy(money, decimal))
    for index, (pattern, _) in enumerate(DATE_FORMATS):
        chosen = chosen.when(F.col(f"date{index}") / filled >= THRESHOLD, strategy(DATE, none, F.lit(pattern)))
    return chosen.otherwise(strategy(TEXT))


# --- conversion ------------------------------------------------------------

def convert(value: Column, strategy: Strategy, decimal_scale: int | None = None) -> Column:
    """Column converted by its strategy; cells that do not fit become null.

    Text must be stripped already.
    """
    if strategy.type in (NUMBER, CURRENCY):
        number = value.cast("double") if strategy.native else _number(value, strategy.decimal)
        if decimal_scale is not None:
            exact = value if strategy.native else number
            return exact.try_cast(f"decimal(38,{decimal_scale})")
        return number
    if strategy.type == DATE:
        if strategy.native:
            return value.cast("timestamp_ntz")
        shape = dict(DATE_FORMATS)[strategy.date_format]
        return F.when(value.rlike(shape), to_moment(value, strategy.date_format))
    if strategy.type == BOOLEAN:
        if strategy.native:
            return value
        word = F.lower(value)
        return F.when(word.isin(*TRUE_TOKENS), True).when(word.isin(*FALSE_TOKENS), False)
    return missing_to_null(value)


def convert_by(value: Column, kind: str, strategy: Column) -> Column:
    """A stripped text as ``kind``, by the decimal sign and date format of a strategy in a column.

    For files that write the same kind of column differently.
    """
    if kind in (NUMBER, CURRENCY):
        return F.when(strategy["decimal"] == ",", _number(value, ",")).otherwise(_number(value, "."))
    if kind == DATE:
        moments = [
            F.when((strategy["date_format"] == pattern) & value.rlike(shape), to_moment(value, pattern)) for pattern, shape in DATE_FORMATS
        ]
        return F.coalesce(*moments)
    return convert(value, Strategy(kind))


def missing_to_null(text: Column) -> Column:
    """Null for a stripped text that stands for a missing cell."""
    return F.when(~F.lower(text).isin(*NULL_TOKENS), text)


def normalize_missing(value: Column) -> Column:
    """Strip a text; null if what is left stands for a missing cell."""
    return missing_to_null(strip(value))


def _without_money_marks(text: Column) -> Column:
    for word in MONEY_WORDS:
        text = F.replace(text, F.lit(word), F.lit(""))
    return F.translate(text, MONEY_SIGNS + WHITESPACE, "")


def _signed(text: Column) -> Column:
    """Parentheses around an amount mean that it is negative."""
    return F.when(F.startswith(text, F.lit("(")), F.regexp_replace(text, ACCOUNTING, "-$1")).otherwise(text)


def _number(value: Column, decimal: str | None) -> Column:
    text = _signed(_without_money_marks(value))
    if decimal == ",":
        text = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    else:
        text = F.replace(text, F.lit(","), F.lit(""))
    return to_double(text)


def coerce(
    df: DataFrame, strategies: dict[str, Strategy] | None = None, decimal_scale: int | None = None, **options
) -> DataFrame:
    """Infer where needed, then convert every column in one projection."""
    strategies = strategies if strategies is not None else infer(df, **options)
    hidden = [col(c) for c in df.columns if c.startswith(HIDDEN)]
    clean = df.select(
        *((col(n) if s.native else strip(col(n).cast("string"))).alias(n) for n, s in strategies.items()), *hidden
    )
    typed = clean.select(*(convert(col(n), s, decimal_scale).alias(n) for n, s in strategies.items()), *hidden)
    return with_logical_types(typed, {n: s.type for n, s in strategies.items()})
