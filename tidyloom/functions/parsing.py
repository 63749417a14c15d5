"""Tolerant conversion of text columns; what does not convert becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyloom.functions.literals import ISO_MOMENT, two_digit_year

# Fixed value: the plain decimal form accepted once symbols are gone.
PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_double(text: Column) -> Column:
    """Plain decimal text to double. Other forms, such as ``12d``, come out empty first."""
    return F.regexp_extract(text, PLAIN_NUMBER, 0).try_cast("double")


def to_moment(text: Column, pattern: str) -> Column:
    """Text to a zone-less timestamp by a Java pattern."""
    parsed = F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    return two_digit_year(parsed, pattern)


def iso_moment(text: Column) -> Column:
    """ISO text to a zone-less timestamp, with dashes or slashes."""
    clean = F.regexp_replace(F.btrim(text), r"\s*Z$", "")
    dashed = F.regexp_replace(clean, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    return F.when(F.btrim(text).rlike(ISO_MOMENT), dashed.try_cast("timestamp_ntz"))
