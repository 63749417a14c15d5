"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. The perfect binary
Golay code puts every 23-bit segment within 3 bits of one codeword; a segment at 3 bits
has five more codewords at 4. Two segments that differ in one bit share at least one of
these nearby codewords. With at most two differing bits in all, either the short segment
is equal and one long segment has one error at most, or one long segment is equal and the
other has one error at most: so equal segment and shared codeword together make the
keys, of which a fingerprint has up to 24. Pairs that share a key are verified.

Links are found between different fingerprints; documents with the same one belong
together without a link. A key shared by many fingerprints is not paired off: each of
them gives its 65 midpoints (itself and every change of one bit), and fingerprints with a
common midpoint differ in two bits at most and are linked to the smallest. That is
exact and grows with the number of fingerprints, not with its square.

Defined cases: a null text or one without words has the fingerprint zero, which links
like any other; a text of one or two words is one shingle; equal rows share all results; a
null doc_id takes part but is not a smallest doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import saved, whole
from tidyloom.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Members up to which the pairs of a key are compared one by one.
PAIRED = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

# Fixed value: generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash of lower-cased word shingles."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        own = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())]
        bits = np.unpackbits(np.array(own, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_ = (counts * 2 > len(starts)).astype(np.uint64)
    return int((set_ << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by ``fp``; the other columns pass through."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "fp")]
    schema = docs.select(*(f.name for f in kept), F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            own = pa.array([fingerprint(t) for t in texts], pa.int64())
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [own], [*names, "fp"])

    return docs.mapInArrow(run, schema)


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of 12-bit message parts and, per syndrome, the error patterns to try.

    Patterns are those of at most 4 bits; a syndrome has one, or one of 3 bits and five
    of 4. Missing ones repeat the first.
    """
    def remainder(value: int) -> int:
        for bit in range(22, 10, -1):
            if value >> bit & 1:
                value ^= GENERATOR << (bit - 11)
        return value

    single = [remainder(1 << b) for b in range(23)]
    found: list[list[int]] = [[] for _ in range(1 << 11)]

    def grow(pattern: int, syndrome: int, start: int, left: int) -> None:
        found[syndrome].append(pattern)
        if left:
            for b in range(start, 23):
                grow(pattern | 1 << b, syndrome ^ single[b], b + 1, left - 1)

    grow(0, 0, 0, 4)
    patterns = np.array([(p * 6)[:6] if len(p) == 1 else p for p in found], np.int64)
    high = np.array([remainder(m << 11) for m in range(1 << 12)], np.int64)
    return high, patterns


def codewords(segments: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(n, 6) indices of the codewords near each 23-bit segment, repeated where fewer."""
    high, patterns = tables
    syndromes = high[segments >> 11] ^ (segments & 0x7FF)
    return (segments[:, None] ^ patterns[syndromes]) >> 11


def keys(prints: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(n, 24) keys of fingerprints, repeated where fewer; sharing one is necessary for a link."""
    first, second, third = prints & 0x7FFFFF, prints >> 23 & 0x7FFFFF, prints >> 46 & 0x3FFFF
    near_first, near_second = codewords(first, tables), codewords(second, tables)
    kinds = ((third, near_first), (third, near_second), (first, near_second), (second, near_first))
    return np.concatenate([(i << 40) | (exact[:, None] << 12) | near for i, (exact, near) in enumerate(kinds)], axis=1)


def _keyed(prints: DataFrame) -> DataFrame:
    """(key, fp) for every distinct key of every fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            made = np.sort(keys(own, tables), axis=1)
            new = np.ones(made.shape, bool)
            new[:, 1:] = made[:, 1:] != made[:, :-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[new]), pa.array(np.repeat(own, new.sum(axis=1)))], ["key", "fp"]
            )

    return prints.mapInArrow(run, "key long, fp long")


def links(prints: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints ``fp`` that connect all within DISTANCE bits."""
    keyed = saved(_keyed(prints))
    counts = saved(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = saved(keyed.join(counts, "key"))
    few = shared.where(F.col("n") <= PAIRED)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where((F.col("a") < F.col("b")) & near)
    many = shared.where(F.col("n") > PAIRED).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)))
    middle = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    least = middle.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mid", "b")
    stars = middle.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.select("a", "b").unionByName(stars).distinct()


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id) of every fingerprint."""
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(prints.select("fp").distinct()))
    # Only fingerprints with a link need the second step; the others keep their own first row.
    roots = linked.join(own.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first").alias("least"))
    joined = linked.join(roots, "root").select(F.col("node").alias("fp"), "least")
    return own.join(joined, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    prints = saved(fingerprints(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))))
    return prints.join(_classes(prints), "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class: those with its smallest key, once.

    Keys decide without the texts; only rows that share key and fingerprint, repeats of
    a document, are compared by their texts, and the smallest stays. A class without any
    key is represented by its smallest text.
    """
    prints = saved(fingerprints(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.md5(F.encode(whole(text), "UTF-8")).alias("digest"))))
    placed = prints.join(saved(_classes(prints)), "fp").groupBy(
        "component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"), "doc_id", "digest"
    ).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n"))
    kept = placed.groupBy("component_id", "fp").agg(first.alias("f")).select(
        F.col("f.doc_id").alias("__id"), F.col("f.digest").alias("__digest"), F.col("f.n").alias("__n")
    )
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.md5(F.encode(whole(text), "UTF-8")) == F.col("__digest"))
    joined = docs.join(saved(kept), same)
    # Only repeats are compared as whole rows; the way through the join is shared.
    return joined.where("__n = 1").unionByName(joined.where("__n > 1").dropDuplicates([key, text])).select(docs.columns)
