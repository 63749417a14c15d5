"""Which files of a folder were looked at before, and scans of some of its files.

What is derived from a file is stored with the file's path, size and time of change, so
that new and changed files can be told from those that were looked at, and rows
of files that changed or are gone can be left out. Names are all that is compared; no
file is opened for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.model import HIDDEN, col

PATH, SIZE, CHANGED = HIDDEN + "path", HIDDEN + "size", HIDDEN + "changed"
IDENTITY = [PATH, SIZE, CHANGED]
_PARTS = {PATH: "file_path", SIZE: "file_size", CHANGED: "file_modification_time"}


def listing(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """One row per file below a folder."""
    found = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(folder)
    return found.select(*(F.col(f"_metadata.{part}").alias(name) for name, part in _PARTS.items()))


def stored(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """Rows of a store, none before it is first written."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(store) if there else spark.createDataFrame([], schema)


def unseen(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files of a listing that have no row yet, or changed since."""
    return files.join(rows.select(*IDENTITY).distinct(), IDENTITY, "left_anti")


def current(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of files that are still there as they were."""
    return rows.join(files, IDENTITY, "left_semi")


def scan(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """All rows of the named files, with the identity of the file; other files are not opened.

    The names go into the plan, where Spark leaves out the other files before it makes tasks.
    """
    names = [r[0] for r in files.select(PATH).distinct().collect()]
    whole = spark.read.parquet(folder)
    identity = [F.col(f"_metadata.{part}").alias(name) for name, part in _PARTS.items()]
    return whole.where(F.col("_metadata.file_path").isin(names)).select(*(col(c) for c in whole.columns), *identity)
