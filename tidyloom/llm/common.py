"""What several operators share: tables that cut lineage, words, running totals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.session import shared_folder

#: Every white space that separates words, as a Java character class and as plain text.
SPACE = "[ \\t-\\r]"
SPACES = " \t\n\x0b\x0c\r"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder that all executors share and read it back.

    Later steps read files instead of recomputing, so a lost executor costs only its
    own tasks. The folder goes when the session's file system is closed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(whole(text), f"{SPACE}+"), lambda w: w != "")


def word_count(text: str | Column) -> Column:
    """Number of words, without building them twice; 0 for null."""
    bare = F.btrim(whole(text), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"{SPACE}+"))).cast("long")


def running(partition: list[str], order: list[str]):
    """Window over all rows of a part up to and with the current one and its ties."""
    return Window.partitionBy(*partition).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def before(partition: list[str], order: list[str]):
    """Window over the rows of a part before the current one."""
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
