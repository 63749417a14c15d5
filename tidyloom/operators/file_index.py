"""Which files of a folder can hold a value or a text, told before any of them is read.

Folded text (``lower(trim(c))``) cannot be pushed to a Parquet scan, nor can a search in all
columns of a row. So for each file is stored

* per text column the least and greatest folded value and a Bloom filter of all of them, and
* a Bloom filter of the trigrams of its rows, as the search sees them.

A Bloom filter is a set of bitmaps of 32,768 bits, about one for PER_BITMAP keys; a key belongs
to one of them and sets MARKS bits there. It tells about one absent key in a hundred as present and
never a present one as absent. Files told are read and the ordinary filter or search is applied
to their rows, so results are those without the index. Files that are not in the index or changed since are read
as well.

Keys are made distinct before the shuffle by file, in the map tasks, and bitmaps are built by file
and bitmap, so a large file is spread over tasks. Null and empty values: a null is no key,
and the empty text is one. Without files there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.errors import RecipeError
from tidyloom.functions.text import display_text, fold
from tidyloom.model import schema_of
from tidyloom.operators.access import search
from tidyloom.operators.filters import predicate
from tidyloom.plans.frame import Frame, frame_of
from tidyloom.session import written
from tidyloom.sources.seen_files import CHANGED, IDENTITY, PATH, SIZE, current, listing, scan, stored, unseen

BITS = 32_768
PER_BITMAP = 3_000
MARKS = 4
#: Code points of the least and greatest value that are stored.
EDGE = 64
#: Kind of the keys that are trigrams of rows; columns are kinds by their name.
ROWS = "rows"
TYPES = {
    PATH: "string", SIZE: "long", CHANGED: "timestamp", "kind": "string", "least": "string", "most": "string",
    "keys": "long", "bitmaps": "long", "bitmap": "long", "bits": "binary",
}
SCHEMA = ", ".join(f"`{name}` {kind}" for name, kind in TYPES.items())


def _haystack(df: DataFrame, types: dict[str, str] | None) -> Column:
    """The text of a row that a search looks at."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(display_text(c), F.lit("")) for c in schema_of(df, types).columns)))


def _trigrams(text: Column) -> Column:
    """All runs of three code points, from three passes of the pattern, each at another start."""
    passes = [F.regexp_extract_all(F.substring(text, i, 2**31 - 1), F.lit("(?s)..."), F.lit(0)) for i in (1, 2, 3)]
    return F.array_distinct(F.concat(*passes))


def _kind(column: str) -> str:
    return f"column {column}"


def _bitmap(key: Column, bitmaps: Column) -> Column:
    return F.pmod(F.xxhash64(key), bitmaps)


def _marks(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BITS)) for i in range(MARKS)]


def _indexed(df: DataFrame, columns: list[str], types: dict[str, str] | None, rows: bool) -> DataFrame:
    """One row per file, kind and bitmap."""
    shown = df.drop(*IDENTITY)
    schema = schema_of(shown, types)
    kinds = []
    for spec in schema.resolve_all(columns) if columns else []:
        if not spec.is_text:
            raise RecipeError(f'Column "{spec.name}" holds no text; its bounds are in the files themselves.')
        kinds.append(F.struct(F.lit(_kind(spec.name)).alias("kind"), F.array(fold(spec.col().cast("string"))).alias("keys")))
    if rows:
        kinds.append(F.struct(F.lit(ROWS).alias("kind"), _trigrams(_haystack(shown, types)).alias("keys")))
    keys = df.select(*IDENTITY, F.inline(F.array(*kinds))).select(*IDENTITY, "kind", F.explode("keys").alias("key"))
    keys = keys.where(F.col("key").isNotNull()).select(*IDENTITY, "kind", F.left("key", F.lit(EDGE)).alias("edge"), F.xxhash64("key").alias("h"), *(
        m.alias(f"m{i}") for i, m in enumerate(_marks(F.col("key")))))
    own = [*IDENTITY, "kind"]
    # The edge is a function of the key. As one more key it lets the map tasks combine by hash; a least text would have them sort all keys.
    different = written(keys.distinct())
    sizes = different.groupBy(*own).agg(
        F.count(F.lit(1)).alias("keys"), F.min("edge").alias("least"), F.max("edge").alias("most")
    ).withColumn("bitmaps", F.ceil(F.col("keys") / PER_BITMAP))
    # One row per file and kind.
    placed = different.drop("edge").join(sizes, own).withColumn("bitmap", F.pmod("h", "bitmaps"))
    marked = placed.select(*own, "least", "most", "keys", "bitmaps", "bitmap", F.explode(F.array(*(f"m{i}" for i in range(MARKS)))).alias("mark"))
    built = marked.groupBy(*own, "least", "most", "keys", "bitmaps", "bitmap").agg(F.bitmap_construct_agg("mark").alias("bits"))
    return built.select(*(F.col(name).cast(kind).alias(name) for name, kind in TYPES.items()))


def refresh(
    spark: SparkSession, folder: str, store: str, columns: list[str] | None = None, types: dict[str, str] | None = None, rows: bool = True
) -> DataFrame:
    """Index the files that are new or changed; returns these files.

    ``columns`` are the text columns to tell values of, ``rows`` says whether to tell texts of
    rows. One writer at a time, always with the same choice. A file without any key is read in every
    query and looked at again each time.
    """
    if not columns and not rows:
        raise RecipeError("Nothing to index.")
    new = written(unseen(listing(spark, folder), stored(spark, store, SCHEMA)))
    _indexed(scan(spark, folder, new), columns or [], types, rows).write.mode("append").parquet(store)
    return new


def _hit(key: Column) -> Column:
    """Whether the bitmap of a row is that of the key and has all its bits."""
    byte = lambda m: F.conv(F.hex(F.substring(F.col("bits"), (F.floor(m / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bits = [F.getbit(byte(m), (m % 8).cast("int")) == 1 for m in _marks(key)]
    return (F.col("bitmap") == _bitmap(key, F.col("bitmaps"))) & bits[0] & bits[1] & bits[2] & bits[3]


def _told(spark: SparkSession, folder: str, store: str, kind: str, passed: Column) -> DataFrame:
    """Files that pass by their index, and those it knows nothing of for this kind."""
    files = written(listing(spark, folder))
    known = current(stored(spark, store, SCHEMA).where(F.col("kind") == kind), files).groupBy(*IDENTITY).agg(passed.alias("passed"))
    return files.join(known.where(~F.coalesce("passed", F.lit(False))), IDENTITY, "left_anti")


def files_with(spark: SparkSession, folder: str, store: str, column: str, values: list[str]) -> DataFrame:
    """Files that can hold one of the values in the column, case and spaces around them aside."""
    if not all(isinstance(value, str) for value in values):
        raise RecipeError("Only texts can be looked up.")
    tests = []
    for value in values:
        key = fold(F.lit(value))
        edge = F.left(key, F.lit(EDGE))
        tests.append((F.col("least") <= edge) & (edge <= F.col("most")) & _hit(key))
    either = F.lit(False)
    for test in tests:
        either = either | test
    return _told(spark, folder, store, _kind(column), F.bool_or(either))


def files_showing(spark: SparkSession, folder: str, store: str, text: str) -> DataFrame:
    """Files that can hold a row which shows the text; all of them for fewer than three signs."""
    folded = spark.range(1).select(_trigrams(F.lower(F.lit(text))).alias("keys")).first()[0]
    if not folded:
        return listing(spark, folder)
    # Each key belongs to one bitmap of a file, so hits can be added up.
    hits = F.aggregate(F.array(*map(F.lit, folded)), F.lit(0), lambda n, key: n + _hit(key).cast("int"))
    return _told(spark, folder, store, ROWS, F.sum(hits) >= len(folded))


def equal_rows(spark: SparkSession, folder: str, store: str, column: str, values: list[str], types: dict[str, str] | None = None) -> Frame:
    """Rows whose text in the column is one of the values, from the files that can hold them."""
    df = scan(spark, folder, files_with(spark, folder, store, column, values)).drop(*IDENTITY)
    frame = frame_of(df, types)
    node = {"type": "condition", "column": column, "operator": "in", "values": values}
    return frame.where(predicate({"type": "group", "logic": "AND", "children": [node]}, frame.schema))


def found_rows(spark: SparkSession, folder: str, store: str, text: str, types: dict[str, str] | None = None) -> Frame:
    """Rows that show the text, from the files that can hold them."""
    df = scan(spark, folder, files_showing(spark, folder, store, text)).drop(*IDENTITY)
    return search(frame_of(df, types), text)
