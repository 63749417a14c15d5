"""Records of delimited text files in any mix of layouts, read in one plan.

All files are read as lines, by as many tasks as their bytes ask for, also where quoted cells
hold line ends. Whether a line starts inside quotes follows from the lines before it: a
line maps "outside" and "inside" to what holds at its end. Such maps are composed inside each
block of a file, then over the few blocks of the file, so every line knows its state without a
task that reads the file from its start. Lines that begin inside quotes join the record
before them.

Encoding and separator of a file, and its header, are data as well: one row per
file, joined to its records. So neither the number of files nor that of different headers
changes the plan, and no list of files comes to the driver.

A quote opens a cell only at its start, and a pair of quotes inside stands for one; other
quotes are signs like any other. Line ends inside a cell are read as a line feed. Blank records are
left out. Empty cells are null, quoted empty ones are empty texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidyloom.errors import SourceError
from tidyloom.session import written
from tidyloom.sources import headers
from tidyloom.sources.admission import TEXT_FILES, admit, decoded, judge_lines, same_form

for _module in (sys.modules[__name__], headers):
    cloudpickle.register_pickle_by_value(_module)

#: Refused files that an error names.
NAMED = 20
#: What a task reads at least of files in small pieces, if there is enough for all cores.
TASK_BYTES = 32 * 1024**2
#: Takes the place of separators between cells; files with this sign are refused.
NUL = "\u0000"
#: States in front of a quote: outside a cell's start, inside quotes, behind a closing quote, at the start of a line.
OUT, IN, CLOSED, START = range(4)


@dataclass(frozen=True)
class Records:
    """Rows ``(source, block, row, cells)`` and, per file, ``(source, names)``."""

    rows: DataFrame
    headers: DataFrame


def read_records(spark: SparkSession, *paths: str, refused: str = "raise", pieces: str | None = None, **limits) -> Records:
    """Records of all text files below the paths. Files are read in ``pieces`` of this size, by default those of Spark.

    Files that cannot be admitted raise an error that names them, unless ``refused`` is
    "skip"; files that are not text are left to others.
    """
    # Read once from the files; their lines are looked at several times.
    lines = _in_pieces(spark, paths, pieces)
    found = written(admit(spark, *paths, lines=_placed(lines), **limits).where("kind = 'csv' OR reason = 'file is empty'"))
    if refused != "skip":
        name_refused(found.where("NOT ok"))
    files = found.where("ok").select(F.col("path").alias("source"), "encoding", "separator", "multiline")
    return records(lines, files)


def name_refused(bad: DataFrame) -> None:
    """Raise an error with the first files of ``(path, reason)``, if there are any."""
    named = bad.select("path", "reason").orderBy("path").limit(NAMED).collect()
    if named:
        raise SourceError("Files were refused: " + "; ".join(f"{r['path']} ({r['reason']})" for r in named))


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines ``(source, block, row, line)`` of text files as they are stored, by as many tasks as they need."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", TEXT_FILES).text(list(paths))
    return placed_lines(read.select("value", "_metadata.file_path", "_metadata.file_block_start"))


def placed_lines(read: DataFrame) -> DataFrame:
    """The same for ``(value, file_path, file_block_start)`` as a reader delivers them."""
    return read.select(
        same_form(F.col("file_path")).alias("source"), F.col("file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("line"),
    )


def _in_pieces(spark: SparkSession, paths: tuple[str, ...], pieces: str | None) -> DataFrame:
    size, usual = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(size, pieces or usual)
    try:
        return written(gathered(text_lines(spark, *paths)))
    finally:
        spark.conf.set(size, usual)


def gathered(lines: DataFrame) -> DataFrame:
    """The same lines by fewer tasks where files are read in small pieces: a task takes several, up to ``TASK_BYTES``, but four a core are left."""
    spark = lines.sparkSession
    pieces = lines.rdd.getNumPartitions()
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = max(pieces * size // TASK_BYTES, 4 * spark.sparkContext.defaultParallelism)
    return lines.coalesce(tasks) if size < TASK_BYTES and tasks < pieces else lines


def _placed(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("source").alias("path"), F.struct("block", "row").alias("at"), "line")


def judged_files(lines: DataFrame) -> DataFrame:
    """Layout ``(source, encoding, separator, multiline)`` of files by their lines alone; files with a zero byte are left out."""
    looked = judge_lines(_placed(lines))
    return looked.where(~F.col("zero")).select(F.col("path").alias("source"), "encoding", "separator", "multiline")


def records(lines: DataFrame, files: DataFrame) -> Records:
    """Records of ``lines`` with the layouts ``(source, encoding, separator, multiline)`` of their files."""
    read = lines.join(files, "source").select(
        "source", "block", "row", decoded(F.col("line"), F.col("encoding")).alias("line"), F.col("separator").alias("sep"), "multiline"
    )
    plain = read.where(~F.col("multiline")).select("source", "block", "row", F.col("line").alias("record"), "sep")
    whole = plain.unionByName(joined_lines(read.where("multiline").drop("multiline")))
    # A mark at the start of a file belongs to no cell.
    bare = F.when((F.col("block") == 0) & F.startswith("record", F.lit("﻿")), F.substring("record", 2, 2**31 - 1)).otherwise(F.col("record"))
    whole = whole.withColumn("record", bare).where(F.col("record").rlike("[^\\x00-\\x20]"))
    # Written once: headers, types, rows and metrics read the cells, each the columns it needs, and do not join and split them again.
    split = written(whole.select("source", "block", "row", split_cells(F.col("record"), F.col("sep")).alias("cells")))
    place = F.struct("block", "row")
    # One row a block of a file, combined by hash; a struct as the least of all rows would have them sorted.
    at = split.groupBy("source", "block").agg(F.min("row").alias("row")).groupBy("source").agg(F.min(place).alias("at"))
    first = written(
        split.join(at.select("source", "at.*"), ["source", "block", "row"]).select("source", place.alias("at"), F.col("cells").alias("names"))
        .mapInPandas(_named, "source string, at struct<block: long, row: long>, names array<string>")
    )
    rows = split.join(first.select("source", "at"), "source").where(place != F.col("at")).drop("at")
    return Records(rows, first.select("source", "names"))


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One header a file; the rule for its names is that of all readers."""
    for batch in batches:
        batch["names"] = [headers.normalize_headers(names) for names in batch["names"]]
        yield batch


# --- lines to records ------------------------------------------------------

def _after(state: Column, before: Column, sep: Column) -> Column:
    """State after a quote, from the state in front of the text ``before`` it."""
    opens = F.endswith(before, sep) | ((before == "") & state.isin(CLOSED, START))
    return F.when(state == IN, CLOSED).when(opens, IN).otherwise(OUT)


def _end_state(line: Column, sep: Column, start: int) -> Column:
    """1 if a line ends inside quotes, else 0."""
    pieces = F.split(line, '"')
    folded = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(start), lambda state, text: _after(state, text, sep))
    unchanged = F.lit(1 if start == IN else 0)
    return F.when(F.contains(line, F.lit('"')), (folded == IN).cast("int")).otherwise(unchanged)


def _states(rows: DataFrame, part: list[str], order: str) -> DataFrame:
    """Add ``fixed`` and ``state``: what holds before a row, of rows that map outside to ``o`` and inside to ``i``.

    The last row before that maps both to the same settles it, and rows that swap turn it over
    since. Without such a row (not ``fixed``) the state is that for a start outside, and a start inside gives the other.
    """
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.when((F.col("o") == 1) & (F.col("i") == 0), 1).otherwise(0)
    counted = rows.withColumn("turns", F.coalesce(F.sum(swaps).over(before), F.lit(0)))
    settled = F.when(F.col("o") == F.col("i"), F.pmod(F.col("o") + F.col("turns"), F.lit(2)))
    last = counted.withColumn("settled", F.last(settled, ignorenulls=True).over(before))
    return last.select(
        *rows.columns, F.col("settled").isNotNull().alias("fixed"),
        F.pmod(F.coalesce("settled", F.lit(0)) + F.col("turns"), F.lit(2)).cast("int").alias("state"),
    )


def joined_lines(lines: DataFrame) -> DataFrame:
    """Records ``(source, block, row, record, sep)`` of lines ``(source, block, row, line, sep)``; the place is that of the first line."""
    maps = {"o": _end_state(F.col("line"), F.col("sep"), START), "i": _end_state(F.col("line"), F.col("sep"), IN)}
    block = ["source", "block"]
    known = _states(lines.withColumns(maps), block, "row")
    after = lambda state: F.when(state == 0, F.col("o")).otherwise(F.col("i"))
    outside, inside = F.col("state"), F.when(F.col("fixed"), F.col("state")).otherwise(1 - F.col("state"))
    # What a block does to the state, and where its last record starts, for both states before it. One row a block.
    ends = F.max_by(F.struct(after(outside).alias("o"), after(inside).alias("i")), "row").alias("end")
    starts = [F.max(F.when(state == 0, F.col("row"))).alias(name) for name, state in (("last_o", outside), ("last_i", inside))]
    blocks = _states(known.groupBy(*block).agg(ends, *starts).select(*block, "end.*", "last_o", "last_i"), ["source"], "block")
    own = F.when(F.col("state") == 0, F.col("last_o")).otherwise(F.col("last_i"))
    start = F.when(own.isNotNull(), F.struct(F.col("block"), own.alias("row")))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*block, F.col("state").alias("begin"), F.last(start, ignorenulls=True).over(earlier).alias("carried"))
    told = known.join(blocks, block)
    state = F.when(F.col("fixed") | (F.col("begin") == 0), F.col("state")).otherwise(1 - F.col("state"))
    told = told.withColumn("now", state).withColumn("then", F.when(F.col("now") == 0, F.col("o")).otherwise(F.col("i")))
    upto = Window.partitionBy(*block).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last(F.when(F.col("now") == 0, F.struct("block", "row")), ignorenulls=True).over(upto)
    placed = told.withColumn("at", F.coalesce(latest, "carried"))
    single = placed.where((F.col("now") == 0) & (F.col("then") == 0)).select(*block, "row", F.col("line").alias("record"), "sep")
    parts = placed.where((F.col("now") == 1) | (F.col("then") == 1))
    pieces = F.sort_array(F.collect_list(F.struct("block", "row", "line")))
    several = parts.groupBy("source", "at").agg(F.array_join(F.transform(pieces, lambda p: p["line"]), "\n").alias("record"), F.first("sep").alias("sep"))
    return single.unionByName(several.select("source", "at.block", "at.row", "record", "sep"))


# --- records to cells ------------------------------------------------------

def split_cells(record: Column, sep: Column) -> Column:
    """Array of the cells of a record. Records without a quote take the short way."""
    marked = F.when(F.contains(record, F.lit('"')), _marked(record, sep)).otherwise(F.replace(record, sep, F.lit(NUL)))
    return F.transform(F.split(marked, NUL), _cell)


def _marked(record: Column, sep: Column) -> Column:
    """The record with a mark in place of each separator outside quotes."""
    empty = F.struct(F.lit(START).alias("state"), F.array().cast("array<string>").alias("done"))

    def piece(acc: Column, text: Column) -> Column:
        kept = F.when(acc["state"] == IN, text).otherwise(F.replace(text, sep, F.lit(NUL)))
        return F.struct(_after(acc["state"], text, sep).alias("state"), F.concat(acc["done"], F.array(kept)).alias("done"))

    return F.aggregate(F.split(record, '"'), empty, piece, lambda acc: F.array_join(acc["done"], '"'))


def _cell(raw: Column) -> Column:
    quoted = (F.length(raw) >= 2) & F.startswith(raw, F.lit('"')) & F.endswith(raw, F.lit('"'))
    inner = F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
    return F.when(raw == "", None).when(quoted, inner).otherwise(raw)


def columns_of(found: Records, names: list[str]) -> DataFrame:
    """``(source, block, row)`` and the named columns as text; a file that lacks one has it empty."""
    from tidyloom.model import col

    placed = found.rows.join(found.headers, "source")
    value = lambda name: F.get("cells", F.array_position("names", name).cast("int") - 1)
    hidden = placed.select("source", "block", "row", *(value(n).alias(f"c{i}") for i, n in enumerate(names)))
    return hidden.select("source", "block", "row", *(col(f"c{i}").alias(n) for i, n in enumerate(names)))
