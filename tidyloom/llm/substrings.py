"""Repeated passages across documents, by seed and extension.

Seeds are winnowed anchors: of the word 8-grams in each window of 35 words, the one
with the smallest hash. Equal windows have equal anchors at equal places, so only anchors
that occur twice can belong to a repeat. The windows that chose an anchor make up its
zone, the anchor extended to both sides. Zones that are equal as a whole settle all
their windows at once; where zones differ, one zone of each kind is opened and its
windows are compared. Overlapping repeated windows join to the maximal repeats.

Nothing is compared pair by pair: groups meet only as counts of hashes, so a passage
shared by a third of all documents costs no more than its own rows. Places are known
by a 128-bit hash of the text, since documents with equal texts have equal results.

Defined cases: null, empty and short texts have no windows and stay whole; copies of a
document count as other places, also within one document and in repeated rows; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm import tokens
from tidyloom.llm.common import saved, whole

WINDOW = 35
GRAM = 8
#: A place is packed as start << BITS | windows - 1; a zone has at most WINDOW - GRAM + 1 windows.
BITS = 8


def _leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` values, the place of the smallest, the first of equals."""
    at, have = np.arange(len(values)), 1
    while have < span:
        shift = min(have, span - have)
        left, right = at[: len(at) - shift], at[shift:]
        at = np.where(values[right] < values[left], right, left)
        have += shift
    return at


def zones(found: tokens.Words, window: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, zone hash, text, first window (in its text) and windows of every zone."""
    n = len(found.hash)
    empty = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    if n < window:
        return empty
    runs = tokens.Sequences(found.hash)
    grams = runs.hash(np.arange(n - GRAM + 1), GRAM)
    anchor = _leftmost_least(grams, window - GRAM + 1)
    start = np.flatnonzero(found.doc[: n - window + 1] == found.doc[window - 1 :])
    if not len(start):
        return empty
    own = anchor[start]
    new = np.concatenate(([True], (np.diff(start) != 1) | (np.diff(own) != 0) | (np.diff(found.doc[start]) != 0)))
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(start)])))
    begin, at = start[first], own[first]
    inner = ((at - begin) << 32 | count).astype(np.uint64)
    zone = tokens.mix(runs.hash(begin, count + window - 1) + inner * np.uint64(tokens.BYTE))
    doc = found.doc[begin]
    return grams[at], zone, doc, begin - found.bounds[doc], count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """Add the 128-bit hash of the text as two numbers."""
    digest = F.md5(F.encode(whole(text), "UTF-8"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return docs.withColumns({"__k1": half(1), "__k2": half(17)})


def _zones(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("__k1", "__k2"))
            for found in tokens.words(_column(batch, "text").cast(pa.binary()).to_pylist()):
                anchor, zone, doc, begin, count = zones(found, window)
                place = begin.astype(np.int64) << BITS | (count - 1)
                row = doc + found.first
                yield pa.RecordBatch.from_arrays(
                    [_signed(anchor), _signed(zone), pa.array(k1[row]), pa.array(k2[row]), pa.array(place)], ["a", "z", "k1", "k2", "place"]
                )

    return docs.mapInArrow(run, "a long, z long, k1 long, k2 long, place long")


def _packed(docs: DataFrame) -> DataFrame:
    """Replace ``text`` by its compressed form, for the way through a shuffle."""
    schema = docs.withColumn("text", F.col("text").cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else pack.compress(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            columns = [pa.array(texts, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, schema)


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [b"" if t is None else unpack.decompress(t) for t in _column(batch, "text").to_pylist()]


def _windows(opened: DataFrame, window: int) -> DataFrame:
    """(a, w, m, k1, k2, s) for every window of the zones to open: places, anchors and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            lists = _column(batch, "open").to_pylist()
            for found in tokens.words(_unpacked(batch)):
                runs = tokens.Sequences(found.hash)
                mine = [(d, x["place"], x["a"], x["m"]) for d in range(found.texts) for x in lists[found.first + d]]
                doc, place, a, m = (np.array(c, np.int64) for c in zip(*mine, strict=True)) if mine else (np.zeros(0, np.int64),) * 4
                count = (place & ((1 << BITS) - 1)) + 1
                row = np.repeat(np.arange(len(mine)), count)
                s = np.repeat((place >> BITS) - np.cumsum(count) + count, count) + np.arange(count.sum())
                w = runs.hash(s + found.bounds[doc[row]], window)
                at = doc[row] + found.first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[row]), _signed(w), pa.array(m[row]), pa.array(k1[at]), pa.array(k2[at]), pa.array(s)], ["a", "w", "m", "k1", "k2", "s"]
                )

    return opened.mapInArrow(run, "a long, w long, m long, k1 long, k2 long, s long")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """Replace text and __spans by n_words, n_removed and kept, the text of the other words."""
    others = [f.name for f in docs.schema.fields if f.name not in ("text", "__spans")]
    schema = docs.select(*others, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            places = _column(batch, "__spans")
            for text, spans in zip(_unpacked(batch), places, strict=True):
                own = text.split()
                sizes.append(len(own))
                if spans.is_valid and len(spans.values):
                    place = spans.values.to_numpy(zero_copy_only=False)
                    begin = place >> BITS
                    change = np.bincount(begin, minlength=len(own) + 1) - np.bincount(begin + (place & ((1 << BITS) - 1)) + window, minlength=len(own) + 1)
                    free = np.cumsum(change[:-1]) == 0
                    own = [own[i] for i in np.flatnonzero(free).tolist()]
                removed.append(sizes[-1] - len(own))
                kept.append(b" ".join(own))
            columns = [_column(batch, n) for n in others]
            columns += [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "n_words", "n_removed", "kept"])

    return docs.mapInArrow(run, schema)


def _spans(keyed: DataFrame, window: int) -> DataFrame:
    """(k1, k2, spans): per text the places of its repeated windows."""
    seeds = saved(_zones(keyed.select("__k1", "__k2", whole("text").alias("text")), window))
    # Kept as tables of their own, so that joins can split a frequent anchor among tasks.
    often = saved(seeds.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"))
    seeds = saved(seeds.join(often, "a"))
    kinds = saved(seeds.groupBy("a", "z").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("k1", "k2", "place")).alias("at")))
    whole_zones = seeds.join(kinds.where("m > 1").select("a", "z"), ["a", "z"]).select("k1", "k2", "place").distinct()
    # An anchor whose zones differ, with one zone at least that has no equal.
    unsettled = saved(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("least")).where("n > 1 AND least = 1").select("a"))
    opened = kinds.join(unsettled, "a").select("at.k1", "at.k2", F.struct("at.place", "a", "m").alias("x")).groupBy("k1", "k2").agg(F.collect_list("x").alias("open"))
    texts = _packed(keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), whole("text").alias("text")))
    # Copies of a text open the same zones, so each place is taken once.
    single = saved(_windows(texts.join(opened, ["k1", "k2"]), window).groupBy("a", "w", "k1", "k2", "s").agg(F.max("m").alias("m")))
    again = saved(single.groupBy("a", "w").agg(F.sum("m").alias("n")).where("n > 1").select("a", "w"))
    parts = single.where("m = 1").join(again, ["a", "w"]).select("k1", "k2", F.shiftleft("s", BITS).alias("place"))
    return whole_zones.unionByName(parts).groupBy("k1", "k2").agg(F.collect_list("place").alias("spans"))


def repeats(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """All columns but the text, with n_words, n_removed and kept (words outside repeats)."""
    others = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept")]
    keyed = _keyed(docs.select(*others, F.col(text).alias("text")), "text")
    spans = saved(_spans(keyed, window)).withColumnsRenamed({"k1": "__k1", "k2": "__k2", "spans": "__spans"})
    joined = _packed(keyed).join(spans, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    return _cut(joined, window)
