"""Parquet datasets and the position of rows in their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.errors import SourceError
from tidyloom.model import HIDDEN


def scan_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def anchor_columns(df: DataFrame) -> dict[str, Column]:
    """Hidden columns which give the rows of a file read their original order.

    Parquet numbers its rows within the file, whatever way it is split. Text
    files have no such number; there the block start and the running number in
    the task restore the order.
    """
    try:
        fields = df.select("_metadata").schema[0].dataType.names
    except Exception as error:
        raise SourceError("row order needs a plain file read or explicit order_by columns") from error
    anchors = {HIDDEN + "file": F.col("_metadata.file_path")}
    if "row_index" in fields:
        anchors[HIDDEN + "row"] = F.col("_metadata.row_index")
    else:
        anchors[HIDDEN + "block"] = F.col("_metadata.file_block_start")
        anchors[HIDDEN + "row"] = F.monotonically_increasing_id()
    return anchors
