"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # Timestamps stay zone-less; UTC keeps casts from zoned values exact.
    "spark.sql.session.timeZone": "UTC",
    # Column names of spreadsheets are case-sensitive.
    "spark.sql.caseSensitive": "true",
    # Windows code pages are common in exported text files.
    "spark.sql.legacy.javaCharsets": "true",
    # Whole files may cross to Python workers; batches are bounded by size, not by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the engine relies on to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    drop_at_end(spark, folder)
    return folder


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the session's file system is closed."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def cut_lineage(df):
    """Materialise ``df`` reliably, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df):
    """The same as a table in the shared folder, whose size later plans know; it goes with the session."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
