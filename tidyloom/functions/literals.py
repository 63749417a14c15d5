"""Values written in recipes, turned into typed literals on the driver.

They reach the plan as constants, so comparisons on raw columns can be pushed
down to the Parquet scan.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.errors import RecipeError
from tidyloom.model import BOOLEAN, ColumnSpec

# Words read as true in a filter or fill value.
TRUE_WORDS = ("true", "sim", "1", "s", "yes")

ISO_MOMENT = (
    r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    r"(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6})\d*)?)?)?\s*Z?$"
)
_ISO = re.compile(ISO_MOMENT)
_WHOLE = re.compile(r"^[+-]?\d+$")
_NUMBER = re.compile(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")

DAY = timedelta(days=1)


def parse_number(value: Any, column: ColumnSpec) -> int | float | Decimal:
    """Number typed by a person: ``1.234,56``, ``R$ 5`` and ``1234.56`` all work.

    Whole numbers stay whole and decimal columns get decimals, so that no digit is lost.
    """
    if isinstance(value, bool):
        raise RecipeError(f'A yes/no value does not fit the numeric column "{column.name}".')
    if isinstance(value, int):
        return value
    if not isinstance(value, float):
        text = str(value).replace("R$", "").replace(" ", "").strip()
        if "," in text:
            text = text.replace(".", "").replace(",", ".")
        if not _NUMBER.match(text):
            raise RecipeError(f'"{value}" is not a valid number for the column "{column.name}".')
        if _WHOLE.match(text):
            return int(text)
        if isinstance(column.data_type, T.DecimalType):
            return Decimal(text)
        value = float(text)
    if not math.isfinite(value):
        raise RecipeError(f'"{value}" is not a finite number for the column "{column.name}".')
    return value


def parse_moment(value: Any) -> datetime | None:
    """Instant written as ``YYYY-M-D`` or ``YYYY/M/D`` with an optional time; None if malformed."""
    match = _ISO.match(str(value).strip())
    if not match:
        return None
    year, month, day, hour, minute, second, fraction = match.groups()
    try:
        return datetime(
            int(year), int(month), int(day), int(hour or 0), int(minute or 0), int(second or 0),
            int((fraction or "0").ljust(6, "0")),
        )
    except ValueError:
        return None


def start_of_day(moment: datetime) -> datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)


def moment_literal(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def coerce(value: Any, column: ColumnSpec) -> Any:
    """Python value of the column's own kind; None stays None."""
    if value is None:
        return None
    if column.is_numeric:
        return parse_number(value, column)
    if column.is_date:
        moment = parse_moment(value)
        if moment is None:
            raise RecipeError(f'"{value}" is not a valid date for the column "{column.name}".')
        return moment
    if column.type == BOOLEAN:
        return value if isinstance(value, bool) else as_text(value).strip().lower() in TRUE_WORDS
    return as_text(value)


def as_text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def literal(value: Any, column: ColumnSpec) -> Column:
    """Literal for a coerced value, as narrow as the column allows."""
    if value is None:
        return F.lit(None)
    if isinstance(value, datetime):
        return moment_literal(value)
    if isinstance(value, float) and column.is_integral and value.is_integer():
        # Keeps the column free of a cast to double, so the filter reaches the scan.
        value = int(value)
    if isinstance(value, (int, Decimal)) and not isinstance(value, bool):
        if isinstance(column.data_type, (T.DoubleType, T.FloatType)) or abs(value) >= 10**38:
            return F.lit(float(value))
        if isinstance(value, int) and not -(2**63) <= value < 2**63:
            return F.lit(Decimal(value))
    return F.lit(value)


# The directives of strptime and of the spelled-out form, as Java patterns.
_STRPTIME = {
    "%d": "d", "%-d": "d", "%m": "M", "%-m": "M", "%Y": "yyyy", "%y": "yy",
    "%H": "H", "%-H": "H", "%I": "h", "%p": "a", "%M": "m", "%-M": "m", "%S": "s", "%-S": "s",
    "%b": "MMM", "%B": "MMMM", "%j": "D", "%f": "SSSSSS", "%%": "%",
}
_SPELLED = {
    "YYYY": "yyyy", "YY": "yy", "DD": "d", "D": "d", "HH": "H", "H": "H", "hh": "h",
    "mm": "m", "m": "m", "ss": "s", "s": "s", "SS": "s",
}


def java_pattern(text: str) -> str:
    """Java date pattern for a ``%d/%m/%Y`` or a ``DD/MM/YYYY HH:mm:ss`` format."""
    tokens = re.findall(r"%-?[A-Za-z%]|[A-Za-z]+|[^A-Za-z%]+", text)
    strptime = "%" in text
    parts = []
    for token in tokens:
        if token.startswith("%"):
            if token not in _STRPTIME:
                raise RecipeError(f'Unknown directive "{token}" in the date format "{text}".')
            parts.append(_STRPTIME[token])
        elif not token[0].isalpha():
            parts.append(token)
        elif strptime or token == "T":
            parts.append("'" + token + "'")
        elif token in ("MM", "M"):
            # After an hour the letters mean minutes, before it the month.
            parts.append("m" if any(p in ("H", "h") for p in parts) else "M")
        elif token.upper() in ("YYYY", "YY", "DD", "D"):
            parts.append(_SPELLED[token.upper()])
        elif token in _SPELLED:
            parts.append(_SPELLED[token])
        else:
            raise RecipeError(f'The date format "{text}" has an unknown part "{token}".')
    return "".join(parts)


def two_digit_year(moment: Column, pattern: str) -> Column:
    """Two-digit years 69-99 belong to the last century."""
    if "yy" not in pattern or "yyyy" in pattern:
        return moment
    late = moment >= F.lit("2069-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(late, moment - F.expr("INTERVAL 100 YEARS")).otherwise(moment)
