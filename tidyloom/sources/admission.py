"""Admission of a folder of files: what each is, whether it is safe, how it is written.

Text files are judged line by line in one distributed scan over all their bytes, so
neither their size nor the place of an odd byte matters. Of archives only the directory
is looked at in Python.
"""

from __future__ import annotations

import io
import re
import struct
import sys
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers get the functions themselves and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Limits on archives, separators in order of preference, extensions.
MAX_RATIO = 150
MAX_EXPANDED = 2 * 1024**3
SEPARATORS = (";", ",", "\t", "|")
EXTENSIONS = (".xlsx", ".xls", ".csv")
# The end record of an archive with the longest comment it may have.
END_BYTES = 22 + 65535

# Stands for a size that does not fit into 32 bits.
_WIDE = 0xFFFFFFFF

_ZIP_START = b"PK\x03\x04"
_OLE_START = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
TEXT_FILES = "*.[cC][sS][vV]"

#: Characters of the Windows code page where it differs from Latin-1.
_WINDOWS = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_UNDEFINED = "[\u0081\u008d\u008f\u0090\u009d]"


def admit(spark: SparkSession, *paths: str, max_bytes: int | None = None, lines: DataFrame | None = None) -> DataFrame:
    """One row per file: path, size, kind, encoding, separator, header, multiline, ok and reason.

    With ``max_bytes`` longer files are refused, by their length, without being opened. ``lines`` are those of the text files as
    ``(path, at, line)``, if they are read already.
    """
    # Without their content: files are listed here, and no reader holds a whole one.
    files = list_files(spark, *paths).select("path", "length").withColumn("kind", _kind())
    if lines is None:
        read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", TEXT_FILES).text(list(paths))
        lines = read.select(
            same_form(F.col("_metadata.file_path")).alias("path"),
            F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
            F.col("value").cast("binary").alias("line"),
        )
    large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    files = files.withColumn("large", large)
    judged = _verdict(files, lines, archives_at(files.where(~F.col("large"))))
    return judged.unionByName(_empty_files(spark, files))


def admit_contents(files: DataFrame) -> DataFrame:
    """The same verdicts for files already held as ``(path, length, content)``."""
    named = files.withColumn("kind", _kind())
    split = named.where("kind = 'csv'").select(
        "path", F.posexplode(F.split(F.decode("content", "ISO-8859-1"), "\r\n|\r|\n")).alias("no", "latin")
    )
    lines = split.select(same_form(F.col("path")).alias("path"), F.struct("no").alias("at"), F.encode("latin", "ISO-8859-1").alias("line"))
    return _verdict(named.withColumn("large", F.lit(False)), lines, _archives(named))


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))


def same_form(path: Column) -> Column:
    """Path without the differences in how Spark writes it."""
    return F.regexp_replace(F.coalesce(F.try_url_decode(path), path), "^file:/+", "file:/")


def _kind() -> Column:
    kind = F.lit(None).cast("string")
    for extension in EXTENSIONS:
        kind = F.when(F.endswith(F.lower("path"), F.lit(extension)), extension[1:]).otherwise(kind)
    return kind


def _empty_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files without a byte: the reader lists them, but gives no row for them."""
    paths = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string").select(same_form(F.col("path")).alias("path"))
    seen = files.select(same_form(F.col("path")).alias("path"))
    none = F.lit(None).cast("string")
    return paths.join(seen, "path", "left_anti").select(
        "path", F.lit(0).cast("long").alias("length"), none.alias("kind"), none.alias("encoding"), none.alias("separator"),
        none.alias("header"), F.lit(False).alias("multiline"), F.lit(None).cast("double").alias("ratio"),
        F.lit(False).alias("ok"), F.lit("file is empty").alias("reason"),
    )


def decoded(content: Column, encoding: Column) -> Column:
    """Text of bytes in one of the encodings that files are judged to have."""
    latin = F.decode(content, "ISO-8859-1")
    windows = F.translate(latin, "".join(_WINDOWS), "".join(_WINDOWS.values()))
    return F.when(encoding == "UTF-8", F.decode(content, "UTF-8")).when(encoding == "windows-1252", windows).otherwise(latin)


def judge_lines(lines: DataFrame) -> DataFrame:
    """How the lines ``(path, at, line)`` of each file are written; one aggregate, combined per task.

    The encoding is the first that fits every byte. The separator is the sign that occurs
    equally often in all lines; failing that, the one in most lines, then the most
    frequent one, and a comma if there is none. Quoted parts do not count. Where cells hold
    line ends, most lines may be parts of cells, so only signs of the header are looked at.
    """
    latin = F.decode("line", "ISO-8859-1")
    # The signs are one byte each, and lengths in bytes need no walk through the text.
    times = lambda text, sign: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))
    bare = F.when(F.contains("latin", F.lit('"')), F.regexp_replace("latin", '"[^"]*"?', "")).otherwise(F.col("latin"))
    read = lines.select("path", "at", "line", latin.alias("latin")).select("*", bare.alias("bare"))
    counted = read.select(
        "path", "at", "line", "latin", (times(F.col("latin"), '"') % 2 == 1).alias("odd"),
        *(times(F.col("bare"), s).alias(f"n{i}") for i, s in enumerate(SEPARATORS)),
        # Longer in UTF-8 if it is not plain ASCII.
        ((F.octet_length("latin") > F.octet_length("line")) & F.col("latin").rlike(_UNDEFINED)).alias("undefined"),
    )
    filled = F.trim("latin") != ""
    numbers = [
        F.struct(
            (F.min(F.when(filled, F.col(f"n{i}"))) == F.max(F.when(filled, F.col(f"n{i}")))).alias("even"),
            F.count_if(F.col(f"n{i}") > 0).alias("lines"), F.sum(f"n{i}").alias("times"),
            F.lit(-i).alias("order"), F.lit(s).alias("sign"), F.min_by(f"n{i}", "at").alias("ahead"),
        ).alias(f"s{i}")
        for i, s in enumerate(SEPARATORS)
    ]
    per_file = counted.groupBy("path").agg(
        F.every(F.is_valid_utf8(F.col("line").cast("string"))).alias("utf8"),
        F.some("undefined").alias("undefined"),
        F.some(F.contains("latin", F.lit("\u0000"))).alias("zero"),
        # As a set, since this has all of them combined by hash; with the line as the only large value they would be sorted.
        F.array_contains(F.collect_set("odd"), True).alias("multiline"),
        F.min_by("line", "at").alias("first"),
        *numbers,
    )
    encoding = F.when(F.col("utf8"), "UTF-8").when(~F.col("undefined"), "windows-1252").otherwise("ISO-8859-1")
    found = F.filter(F.array(*(f"s{i}" for i in range(len(SEPARATORS)))), lambda s: s["times"] > 0)
    ahead = F.filter(found, lambda s: s["ahead"] > 0)
    found = F.when(F.col("multiline") & (F.size(ahead) > 0), ahead).otherwise(found)
    header = decoded(F.col("first"), encoding)
    return per_file.select(
        "path", encoding.alias("encoding"), F.coalesce(F.array_max(found)["sign"], F.lit(",")).alias("separator"),
        F.regexp_replace(header, "^\ufeff", "").alias("header"), "multiline", "zero",
        F.substring("first", 1, 8).alias("start"),
    )


def _archives(files: DataFrame) -> DataFrame:
    """Packed and expanded size of every archive, by its directory however long that is."""
    content = F.col("content")
    found = files.where("kind IN ('xlsx', 'xls')").select("path", "kind", F.substring(content, 1, 8).alias("start"), content)
    is_zip = F.substring("start", 1, 4) == F.lit(_ZIP_START)
    ends = F.hex(F.substr(content, F.greatest(F.lit(1), F.octet_length(content) - END_BYTES + 1), F.lit(END_BYTES)))
    # The end record holds size and start of the directory, low byte first.
    record = F.when(F.contains(ends, F.lit("504B0506")), F.substring_index(ends, "504B0506", -1))

    def number(at: int) -> Column:
        parts = [F.substring(record, at + 2 * i, 2) for i in (3, 2, 1, 0)]
        return F.conv(F.concat(*parts), 16, 10).cast("long")

    directory = F.when(is_zip & (F.col("kind") == "xlsx"), F.substr(content, (number(25) + 1).cast("int"), number(17).cast("int")))
    return found.select(
        same_form(F.col("path")).alias("path"), "start", is_zip.alias("is_zip"), (F.col("start") == F.lit(_OLE_START)).alias("is_ole"),
        directory.alias("directory"),
    ).mapInPandas(_sizes, "path string, is_zip boolean, is_ole boolean, expanded double, ratio double")


def archives_at(files: DataFrame) -> DataFrame:
    """The same for files ``(path, kind, length)`` by their places: only the start, the end record and the directory are read."""
    found = files.where("kind IN ('xlsx', 'xls')").select(same_form(F.col("path")).alias("path"), F.col("path").alias("place"), "kind", "length")
    return found.mapInPandas(_sizes_at, "path string, is_zip boolean, is_ole boolean, expanded double, ratio double")


def _sizes_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, place, kind, length in batch.itertuples(index=False):
            with opened(place) as file:
                start = file.read(8)
                is_zip = start[:4] == _ZIP_START
                packed, expanded = read_directory(file, length) if is_zip and kind == "xlsx" else (None, None)
            ratio = expanded / packed if packed else None
            rows.append((path, is_zip, start == _OLE_START, None if expanded is None else float(expanded), ratio))
        yield pd.DataFrame(rows, columns=["path", "is_zip", "is_ole", "expanded", "ratio"])


def opened(place: str):
    """File of a URI or local path, to be read at any place in it."""
    # Paths are listed without escapes.
    if ":" not in place or place.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", place))
    store, path = fs.FileSystem.from_uri(quote(place, safe=":/@"))
    return store.open_input_file(path)


def read_directory(file, length: int) -> tuple[int | None, int | None]:
    """Packed and expanded size of the archive in a file, entry by entry; None if its directory is damaged."""
    tail_at = max(0, length - END_BYTES)
    file.seek(tail_at)
    tail = file.read(length - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        return None, None
    (size,) = struct.unpack_from("<I", tail, at + 12)
    end, locator = tail_at + at, at - 20
    if size == _WIDE and locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        # The size is in a record of its own, to which the locator points.
        (end,) = struct.unpack_from("<Q", tail, locator + 8)
        file.seek(end)
        wide = file.read(56)
        if len(wide) < 56 or wide[:4] != b"PK\x06\x06":
            return None, None
        (size,) = struct.unpack_from("<Q", wide, 40)
    if not 0 < size <= end:
        return None, None
    # The directory lies right before its end record, also if something was put in front of the archive.
    file.seek(end - size)
    return directory_sizes_of(_Bounded(file, size))


class _Bounded:
    """The next ``left`` bytes of a file, read in pieces."""

    def __init__(self, file, left: int):
        self.file, self.left, self.held = file, left, b""

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self.left:
            piece = self.file.read(min(self.left, 1 << 20))
            self.left = self.left - len(piece) if piece else 0
            self.held += piece
        out, self.held = self.held[:n], self.held[n:]
        return out


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes = [(None, None) if d is None else directory_sizes(bytes(d)) for d in batch["directory"]]
        batch["expanded"] = [float(e) if e is not None else None for _, e in sizes]
        batch["ratio"] = [e / p if p else None for p, e in sizes]
        yield batch[["path", "is_zip", "is_ole", "expanded", "ratio"]]


def directory_sizes(directory: bytes) -> tuple[int | None, int | None]:
    """Packed and expanded size of an archive by its directory; None if that is damaged."""
    return directory_sizes_of(io.BytesIO(directory))


def directory_sizes_of(entries) -> tuple[int | None, int | None]:
    packed = expanded = seen = 0
    while (entry := entries.read(46)) and entry[:4] == b"PK\x01\x02" and len(entry) == 46:
        one_packed, one_expanded, name, extra, comment = struct.unpack_from("<IIHHH", entry, 20)
        more = entries.read(name + extra + comment)[name : name + extra]
        if _WIDE in (one_packed, one_expanded):
            one_packed, one_expanded = _wide_sizes(more, one_packed, one_expanded)
        packed, expanded, seen = packed + one_packed, expanded + one_expanded, seen + 1
    return (packed, expanded) if seen and not entry else (None, None)


def _wide_sizes(extra: bytes, packed: int, expanded: int) -> tuple[int, int]:
    """Sizes beyond 32 bits, which an extra field holds: first the expanded one, then the packed one."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            numbers = list(struct.unpack_from(f"<{min(size, len(extra) - at - 4) // 8}Q", extra, at + 4))
            if expanded == _WIDE and numbers:
                expanded = numbers.pop(0)
            if packed == _WIDE and numbers:
                packed = numbers.pop(0)
        at += 4 + size
    return packed, expanded


def _verdict(files: DataFrame, lines: DataFrame, archives: DataFrame) -> DataFrame:
    """Verdicts for ``(path, length, kind, large)``, the lines of the text files and the sizes of the archives."""
    listed = files.select("path", "length", "kind", "large", same_form(F.col("path")).alias("same"))
    written = judge_lines(lines).withColumnsRenamed({"path": "text_of"})
    packed = archives.withColumnRenamed("path", "archive_of")
    looked = listed.join(written, F.col("same") == F.col("text_of"), "left").join(packed, F.col("same") == F.col("archive_of"), "left")
    kind, is_zip, is_ole = F.col("kind"), F.coalesce("is_zip", F.lit(False)), F.coalesce("is_ole", F.lit(False))
    binary = (F.substring("start", 1, 4) == F.lit(_ZIP_START)) | (F.col("start") == F.lit(_OLE_START)) | F.col("zero")
    reason = (
        F.when(F.col("large"), "file is too large")
        .when(kind.isNull(), "extension is not supported")
        .when(F.col("length") == 0, "file is empty")
        .when((kind == "xlsx") & ~is_zip, "content does not match the extension")
        .when((kind == "xls") & ~(is_ole | is_zip), "content does not match the extension")
        .when((kind == "csv") & F.coalesce(binary, F.lit(False)), "content does not match the extension")
        .when(kind == "xls", "binary workbooks of this kind cannot be read")
        .when((kind == "xlsx") & F.col("expanded").isNull(), "archive is damaged")
        .when(F.col("expanded") > MAX_EXPANDED, "archive is too large when expanded")
        .when(F.col("ratio") > MAX_RATIO, "archive is suspiciously compressed")
        .when((kind == "csv") & (F.trim(F.coalesce("header", F.lit(""))) == ""), "file has no columns")
    )
    shown = looked.withColumn("reason", reason)
    dialect = [F.when(~F.col("large"), F.col(c)).alias(c) for c in ("encoding", "separator", "header")]
    return shown.select(
        "path", "length", "kind", *dialect, F.coalesce("multiline", F.lit(False)).alias("multiline"), "ratio",
        F.col("reason").isNull().alias("ok"), "reason",
    )


def fingerprints(files: DataFrame) -> DataFrame:
    """SHA-256 and size of every file of ``(path, length, content)``."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def repeated_files(files: DataFrame) -> DataFrame:
    """Files whose content occurs under an earlier path, each with the first such path.

    The first paths come from an aggregate that is combined before the shuffle,
    so any number of copies of one file may exist.
    """
    marked = fingerprints(files)
    copies = marked.groupBy("sha256", "length").agg(
        F.min("path").alias("first_path"), F.count(F.lit(1)).alias("n")
    )
    many = copies.where(F.col("n") > 1).drop("n")
    return marked.join(many, ["sha256", "length"]).where(F.col("path") != F.col("first_path")).select(
        "path", "length", "sha256", "first_path"
    )
