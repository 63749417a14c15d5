"""From raw files to a typed Parquet dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidyloom.errors import SourceError
from tidyloom.model import HIDDEN, col
from tidyloom.operators.infer import Strategy, coerce, infer


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write a typed dataset as compressed Parquet and read it back; an empty one is refused."""
    # Asked before anything is written, so that a retry finds the place free.
    if df.isEmpty():
        raise SourceError("The dataset has no rows.")
    visible = [c for c in df.columns if not c.startswith(HIDDEN)]
    df.select(*map(col, visible)).write.mode(mode).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def ingest(spark: SparkSession, raw: DataFrame, path: str) -> tuple[DataFrame, dict[str, Strategy]]:
    """Infer the types of a raw table, convert it and save it."""
    strategies = infer(raw)
    return save(coerce(raw, strategies), path), strategies
