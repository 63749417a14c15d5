"""Delimited text, read as strings whatever the cells hold."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidyloom.errors import SourceError
from tidyloom.sources.admission import admit
from tidyloom.sources.headers import normalize_headers


# Refused files that an error names.
NAMED = 20
# Stands for an empty cell while a line is read. No cell can hold it, since files with this sign are refused.
EMPTY = "\u0000"


@dataclass(frozen=True)
class Layout:
    """What files have in common that can be read together."""

    encoding: str
    separator: str
    header: str
    multiline: bool

    @property
    def columns(self) -> list[str]:
        names = next(csv.reader(io.StringIO(self.header), delimiter=self.separator))
        return normalize_headers(names)


def scan_delimited(
    spark: SparkSession,
    paths: str | list[str],
    columns: list[str],
    separator: str = ",",
    encoding: str = "UTF-8",
    multiline: bool = True,
) -> DataFrame:
    """Read files with a header line. Long rows are cut, short ones filled with nulls.

    Empty cells are null, quoted empty ones are empty texts.
    ``multiline`` lets quoted cells hold line ends, but makes each file one task;
    without it large files are split.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    reader = spark.read.schema(schema)
    for key, value in text_options(separator, encoding, multiline).items():
        reader = reader.option(key, value)
    return reader.csv(paths if isinstance(paths, list) else [paths])


def text_options(separator: str, encoding: str, multiline: bool) -> dict[str, str]:
    return {
        "header": "true", "enforceSchema": "true", "sep": separator, "encoding": encoding, "quote": '"', "escape": '"',
        "multiLine": str(multiline).lower(), "mode": "PERMISSIVE",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
        # With the same text for both, a quoted empty cell would be null as well.
        "nullValue": EMPTY, "emptyValue": "",
    }


def scan_folder(spark: SparkSession, *paths: str, refused: str = "raise", **limits) -> list[tuple[Layout, DataFrame]]:
    """Read all text files of a folder, those of one layout together: one DataFrame per layout.

    Files that cannot be admitted raise an error that names them, unless ``refused`` is
    "skip"; ``admit`` lists them with the reason. Files that are not text are left to others.
    """
    found = admit(spark, *paths, **limits).where("kind = 'csv' OR reason = 'file is empty'")
    if refused != "skip":
        bad = found.where("NOT ok").select("path", "reason").limit(NAMED).collect()
        if bad:
            raise SourceError("Files were refused: " + "; ".join(f"{r['path']} ({r['reason']})" for r in bad))
    files = found.where("ok").select("path", "encoding", "separator", "header", "multiline").collect()
    groups: dict[Layout, list[str]] = {}
    for file in sorted(files, key=lambda f: f["path"]):
        header = file["header"]
        if header.count('"') % 2:
            header = _long_header(spark, file)
        layout = Layout(file["encoding"], file["separator"], header, file["multiline"])
        groups.setdefault(layout, []).append(file["path"])
    return [
        (layout, scan_delimited(spark, names, layout.columns, layout.separator, layout.encoding, layout.multiline))
        for layout, names in groups.items()
    ]


def _long_header(spark: SparkSession, file) -> str:
    """Header whose quoted cells hold line ends, written again as it was."""
    read = spark.read.option("multiLine", "true").option("sep", file["separator"]).option("encoding", file["encoding"])
    first = read.option("escape", '"').csv(file["path"]).first()
    cells = ['"' + (c or "").removeprefix("\ufeff").replace('"', '""') + '"' for c in first]
    return file["separator"].join(cells)
