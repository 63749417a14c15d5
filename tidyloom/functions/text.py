"""Text helpers as built-in expressions: trimming, blanks, display form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.model import ColumnSpec

# The Unicode space separators (category Zs).
SPACES = (
    " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)
# The separators plus control white space and the line and paragraph separators.
WHITESPACE = SPACES + "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f\u0085\u2028\u2029"


def trim_spaces(value: Column) -> Column:
    """Remove space separators at both ends; tabs and line ends stay."""
    return _trim(value, SPACES)


def strip(value: Column) -> Column:
    """Remove every kind of white space at both ends."""
    return _trim(value, WHITESPACE)


def _trim(value: Column, signs: str) -> Column:
    # Most cells have nothing to trim, and a look at both ends is cheaper than
    # the trim itself, which walks through the whole text.
    ends = [F.substring(value, 1, 1), F.substring(value, -1, 1)]
    padded = ends[0].isin(*signs) | ends[1].isin(*signs)
    return F.when(padded, F.btrim(value, F.lit(signs))).otherwise(value)


def fold(value: Column) -> Column:
    """Form in which text is compared when case does not matter."""
    return F.lower(trim_spaces(value))


def display_text(column: ColumnSpec) -> Column:
    """Text form of a column, the same for every width of number.

    Doubles print plainly between 1e-4 and 1e16 (``10000000.0``) and with a signed
    exponent of two digits outside (``1e+16``).
    """
    value = column.col()
    if isinstance(column.data_type, T.FloatType):
        value = value.cast("string").cast("double")
    elif not isinstance(column.data_type, T.DoubleType):
        return value.cast("string")
    size = F.abs(value)
    shortest = _shortest(value)
    digits = F.rtrim(shortest.try_cast("decimal(38,22)").cast("string"), F.lit("0"))
    plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    exponent = F.regexp_replace(F.regexp_replace(shortest, r"(?:\.0)?E(\d)", "e+$1"), r"(?:\.0)?E-", "e-")
    exponent = F.regexp_replace(exponent, r"e([+-])(\d)$", "e$10$2")
    return (
        # Here Java prints the plain form by itself.
        F.when((size >= 1e-3) & (size < 1e7), shortest)
        .when(value == 0, F.when(value.cast("string") == "-0.0", "-0.0").otherwise("0.0"))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .otherwise(exponent)
    )


def _shortest(value: Column) -> Column:
    """Shortest text that reads back as the same double.

    Some Java versions print a seventeenth digit where sixteen would do; such
    long texts are tried again with one digit less.
    """
    printed = value.cast("string")
    shorter = F.format_string("%.15e", value)
    same = shorter.try_cast("double") == value
    shorter = F.regexp_replace(F.regexp_replace(shorter, r"0*e\+0*(\d)", "E$1"), r"0*e-0*(\d)", "E-$1")
    return F.when((F.length(printed) >= 18) & same, shorter).otherwise(printed)


def is_blank(column: ColumnSpec) -> Column:
    """Null, or nothing but spaces when the column holds text. Never null itself."""
    value = column.col()
    if not column.is_text:
        return value.isNull()
    return value.isNull() | (trim_spaces(value.cast("string")) == "")
