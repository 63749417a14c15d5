"""A recipe applied to files as they arrive; each file is one dataset.

The file source delivers a file whole, in one micro-batch, so steps and metrics
that look at a whole dataset are right within a batch.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidyloom.errors import RecipeError
from tidyloom.model import HIDDEN, col
from tidyloom.operators import fleet
from tidyloom.operators import metrics as metric_ops
from tidyloom.operators.infer import Strategy, coerce
from tidyloom.plans import recipe as recipes
from tidyloom.plans.frame import SOURCE, OrderKey, frame_of
from tidyloom.session import written
from tidyloom.sources import records
from tidyloom.sources.admission import TEXT_FILES
from tidyloom.sources.delimited import text_options

BATCH = "batch"
# Lines of batches that are not read yet, in a folder of the output.
WAITING = "waiting"
LINES = f"source string, block long, row long, line binary, {BATCH} long"
POSITION = HIDDEN + "position"
BLOCK = HIDDEN + "block"
# Files that one batch takes at most, also when many are waiting.
FILES_PER_BATCH = 1000


def read_arriving(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_arriving_text(
    spark: SparkSession, path: str, strategies: dict[str, Strategy], separator: str = ",", encoding: str = "UTF-8",
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """Arriving delimited files with a header line, still as text; the columns are those of the strategies."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in strategies])
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    for key, value in text_options(separator, encoding, multiline=True).items():
        reader = reader.option(key, value)
    return reader.csv(path)


def read_arriving_lines(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Lines of arriving text files, whatever their separators, encodings and headers; long files are split among tasks."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", TEXT_FILES).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")


def stream_rows(arriving: DataFrame, recipe: dict, types: dict[str, str] | None = None) -> DataFrame:
    """Recipe of row-wise steps as a transformation of the stream itself."""
    if not recipes.is_stateless(recipe):
        raise RecipeError("Sorting and removing duplicates need whole files; use reapply_arriving.")
    return recipes.apply_steps(frame_of(arriving, types), recipe).visible()


def reapply_arriving(
    arriving: DataFrame, recipe: dict, output: str, checkpoint: str,
    types: dict[str, str] | None = None, once: bool = False, interval: str = "1 minute",
    strategies: dict[str, Strategy] | None = None,
) -> StreamingQuery:
    """Run any recipe on every arriving file and keep results and metrics per file.

    Each batch writes to folders of its own and replaces them when it is repeated
    after a failure, so nothing is lost or doubled. ``strategies`` convert text cells as
    those of an earlier file were.
    """
    recipes.validate(recipe)

    def process(batch: DataFrame, number: int) -> None:
        # Read and converted once, for the rows as well as the metrics.
        held = _placed(batch).persist()
        frame = frame_of(coerce(held, strategies) if strategies else held, types, group_by=[SOURCE])
        frame = replace(frame, anchor=(OrderKey(SOURCE), OrderKey(BLOCK), OrderKey(POSITION)))
        frame = recipes.apply_steps(frame, recipe)
        rows = frame.df.select(*map(col, frame.schema.names), col(frame.group[0]).alias("source_file"))
        rows.write.mode("overwrite").parquet(f"{output}/rows/{BATCH}={number}")
        wanted = recipe.get("metrics") or []
        if wanted:
            measured = metric_ops.compute(frame, wanted)
            measured.write.mode("overwrite").parquet(f"{output}/metrics/{BATCH}={number}")
        held.unpersist()

    writer = positioned(arriving).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def reapply_arriving_text(
    arriving: DataFrame, recipe: dict, output: str, checkpoint: str, strategies: dict[str, Strategy] | None = None,
    columns: list[str] | None = None, types: dict[str, str] | None = None, once: bool = False, interval: str = "1 minute",
) -> StreamingQuery:
    """The same for the lines of text files, each read by its own layout and converted by types of its own.

    ``columns`` and ``types`` keep the results of all batches alike; ``strategies`` fix the conversion as
    well. Files that cannot be read, or disagree with most files of their batch on a type, are named in ``refused``.

    With ``once``, where the types of no file depend on those of others, batches only keep their lines in ``waiting``, and one plan
    reads them all when the last has come, since a plan for two small files takes as long as one for hundreds. The call then
    returns when all is done. Lines that an interrupted run has kept are read by the next one; each batch still has
    folders of its own, which are replaced if it is read again.
    """
    recipes.validate(recipe)
    apart = strategies is not None or (columns is not None and set(columns) <= set(types or {}))

    def process(batch: DataFrame, number: int) -> None:
        # Read once from the source; the lines of a batch are looked at several times.
        _reapply_lines(written(_numbered(batch, number)), recipe, output, strategies, columns, types)

    def keep(batch: DataFrame, number: int) -> None:
        _numbered(batch, number).drop(BATCH).write.mode("overwrite").parquet(f"{output}/{WAITING}/{BATCH}={number}")

    writer = arriving.writeStream.foreachBatch(keep if once and apart else process).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
    if once and apart:
        query.awaitTermination()
        _reapply_waiting(arriving.sparkSession, recipe, output, strategies, columns, types)
    return query


def _numbered(batch: DataFrame, number: int) -> DataFrame:
    return records.placed_lines(batch).withColumn(BATCH, F.lit(number).cast("long"))


def _reapply_waiting(spark: SparkSession, recipe: dict, output: str, *how) -> None:
    """Results of all batches whose lines are kept, which are deleted then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{output}/{WAITING}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return
    lines = spark.read.schema(LINES).parquet(f"{output}/{WAITING}")
    # A file that changed between two runs is there twice, and each time is a dataset.
    twice = lines.groupBy("source").agg(F.min(BATCH).alias("first"), F.max(BATCH).alias("last")).where("first < last")
    if twice.isEmpty():
        _reapply_lines(lines, recipe, output, *how)
    else:
        for row in lines.select(BATCH).distinct().orderBy(BATCH).collect():
            _reapply_lines(lines.where(F.col(BATCH) == row[BATCH]), recipe, output, *how)
    system.delete(path, True)


def _reapply_lines(
    lines: DataFrame, recipe: dict, output: str, strategies: dict[str, Strategy] | None, columns: list[str] | None, types: dict[str, str] | None,
) -> None:
    """Rows, metrics and refused files of batches ``(source, block, row, line, batch)``, no file being in two of them."""
    taken = written(lines.groupBy("source").agg(F.first(BATCH).alias(BATCH)))
    # One row a batch.
    numbers = sorted(r[BATCH] for r in taken.select(BATCH).distinct().collect())
    lines = lines.drop(BATCH)
    files = written(records.judged_files(lines))
    found = records.records(lines, files)
    frame = fleet.reapply_records(found, recipe, strategies, columns, types, refused="skip")
    rows = frame.df.select(*map(col, frame.schema.names), col(frame.group[0]).alias("source_file"))
    _write_batches(rows, taken, "source_file", f"{output}/rows", numbers)
    wanted = recipe.get("metrics") or []
    if wanted:
        # Read from the rows of these batches, which are not worked out again.
        kept = lines.sparkSession.read.schema(rows.schema).parquet(f"{output}/rows/{BATCH}={{{','.join(map(str, numbers))}}}")
        done = replace(frame, df=kept.select(*map(col, frame.schema.names), F.col("source_file").alias(frame.group[0])))
        _write_batches(metric_ops.compute(done, wanted), taken, "source", f"{output}/metrics", numbers)
    read = frame.base.select(col(SOURCE).alias("source")).distinct()
    # Files with nothing but a header have no rows to tell that they were read.
    named = found.headers.select("source").join(found.rows.select("source").distinct(), "source", "left_anti").unionByName(read)
    _write_batches(taken.select("source").join(named, "source", "left_anti"), taken, "source", f"{output}/refused", numbers)


def _write_batches(rows: DataFrame, taken: DataFrame, source: str, path: str, numbers: list[int]) -> None:
    """Write rows to a folder of each batch, in place of what is there; ``taken`` names the batch of every file."""
    # There is one folder at least, which tells the columns also if no batch has rows.
    empty = rows.sparkSession.createDataFrame([], rows.schema)
    empty.write.mode("overwrite").parquet(f"{path}/{BATCH}={numbers[-1]}")
    numbered = rows.join(taken.withColumnRenamed("source", source), source)
    # One task writes a batch, unless it is a large one.
    numbered = numbered.select(*map(col, rows.columns), BATCH).hint("rebalance", F.col(BATCH))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def positioned(arriving: DataFrame) -> DataFrame:
    """Add file and position in the file, which a batch no longer offers by itself."""
    fields = arriving.select("_metadata").schema[0].dataType.names
    known = [F.col("_metadata.row_index").alias(POSITION)] if "row_index" in fields else []
    return arriving.select(
        *map(col, arriving.columns), F.col("_metadata.file_path").alias(SOURCE), F.col("_metadata.file_block_start").alias(BLOCK), *known
    )


def _placed(batch: DataFrame) -> DataFrame:
    """Rows of text files have no number of their own; their order in the task gives one."""
    return batch if POSITION in batch.columns else batch.withColumn(POSITION, F.monotonically_increasing_id())
