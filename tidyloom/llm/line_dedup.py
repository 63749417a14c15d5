"""Fuzzy duplicate lines: MinHash bands, exact Jaccard, one line kept per component.

A line is the set of its character shingles. One-permutation MinHash over them gives
48 minima, 12 bands of 4: a pair at the threshold of 0.8 shares a band with probability
0.998, one at 0.85 with 0.9999. Candidates are verified by the Jaccard similarity
of their full sets, whose shingles are compared by 64-bit hashes.

Buckets are not paired off in a join. The buckets with the same smallest line make one group, so
every pair of a bucket is in a group. A group is dealt by hash into blocks of about BLOCK
lines, and each pair of blocks is a cell that one task compares: it counts what all its lines share
by a product of matrices, in which shingles that occur in the same lines are one column, and
returns one link a line that joins it to others. So rows grow with the lines as long as a
group is one block, beyond that with its blocks, and no task holds more than two blocks. Only
the tests within a cell are one a pair, the square of a group. Lines of a group without a common
bucket are linked as well if they are similar.

The first line of a component, by doc_id (nulls first) and place, stays; the others are
removed. Equal lines count as one line found several times.

Defined cases: blank lines are not compared and stay; a line shorter than a shingle is its
own shingle; null texts have no lines; rows with equal doc_id and text are one document and
share the result; without documents the result is empty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import saved, whole
from tidyloom.llm.components import components
from tidyloom.llm.substrings import _column, _unpacked
from tidyloom.llm.tokens import BYTE, WORD, U, mix, powers

SHINGLE = 7
BANDS, ROWS = 12, 4
SIMILAR = 0.8
#: Characters of text whose shingles are hashed at once; a longer text is looked at alone.
CHUNK = 1 << 20
#: Characters at a time within that, so that the arrays stay in the cache of a core.
SLICE = 1 << 16
#: Draws for an empty bin before its neighbours are asked.
DRAWS = 64
#: Parts of the hash range by which shingles are counted, to bound what two lines share.
PARTS = 128
#: Lines of a group that one task compares with as many others.
BLOCK = 1000
#: Characters of a cell whose shingles are held at once; of more, a share of the hash range at a time.
HELD = 1 << 21
#: Columns of a matrix at a time.
COLUMNS = 1 << 12
#: Up to so many lines are compared one by one.
FEW = 8
#: Rows of buckets for a task, 16 bytes each, and rows it returns at a time.
DEAL, OUT = 1 << 20, 10_000

EMPTY = np.iinfo(np.uint64).max


def lines(text: str | None) -> list[tuple[int, str]]:
    """Number and text of the lines that are not blank."""
    return [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similar(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b)


def _filled(minima: np.ndarray) -> np.ndarray:
    """Give empty bins the value of a full bin of the same line, drawn alike for all lines."""
    bins = minima.shape[1]
    row, bin_ = np.nonzero(minima == EMPTY)
    poor, at = np.unique(row, return_inverse=True)
    own = minima[poor]
    for draw in range(DRAWS):
        if not len(row):
            break
        other = (mix(np.arange(bins, dtype=U) * U(BYTE) + U(draw * bins)) % U(bins)).astype(int)
        minima[row, bin_] = own[at, other[bin_]]
        empty = minima[row, bin_] == EMPTY
        row, bin_, at = row[empty], bin_[empty], at[empty]
    poor = np.unique(row)
    out = minima[poor]
    while (out == EMPTY).any():
        out = np.where(out == EMPTY, np.roll(out, 1, axis=1), out)
    minima[poor] = out
    return minima


def _mixed(x: np.ndarray) -> np.ndarray:
    """``mix`` in place, which spares memory the arrays between."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U(shift)
        x *= U(factor)
    x ^= x >> U(31)
    return x


def _hashed(listed: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line number, hash) of every shingle of every line."""
    points = np.frombuffer("".join(x + "\n" * max(1, SHINGLE - len(x)) for x in listed).encode("utf-32-le"), np.uint32)
    length = np.fromiter(map(len, listed), np.int64, len(listed))
    stride = length + np.maximum(1, SHINGLE - length)
    sums = np.zeros(len(points) + 1, U)
    np.cumsum(_mixed(points.astype(U) + U(1)) * powers(BYTE, len(points)), out=sums[1:])
    values = sums[SHINGLE:] - sums[:-SHINGLE]
    values *= powers(pow(BYTE, -1, 1 << 64), len(values))
    # All places but those from which a shingle would reach into the next line.
    count = np.maximum(1, length - SHINGLE + 1)
    end = np.cumsum(stride)
    inside = np.ones(len(points), bool)
    inside[np.repeat(end - stride + count - np.cumsum(stride - count) + stride - count, stride - count) + np.arange((stride - count).sum())] = False
    return np.repeat(np.arange(len(listed)), count), _mixed(values[inside[: len(values)]])


def _slices(listed: list[str]) -> Iterator[list[str]]:
    """Consecutive lines of about SLICE characters together."""
    start = held = 0
    for i, line in enumerate(listed):
        held += len(line) + 1
        if held >= SLICE:
            yield listed[start : i + 1]
            start, held = i + 1, 0
    if start < len(listed):
        yield listed[start:]


def bands(listed: list[str]) -> np.ndarray:
    """(lines, BANDS) hashes of the bands of every line."""
    minima = _filled(np.concatenate([np.zeros((0, BANDS * ROWS), U), *map(_minima, _slices(listed))])).reshape(len(listed), BANDS, ROWS)
    return mix((minima * powers(WORD, ROWS)).sum(axis=2, dtype=U) + np.arange(1, BANDS + 1, dtype=U))


def _minima(listed: list[str]) -> np.ndarray:
    bins = BANDS * ROWS
    owner, values = _hashed(listed)
    slot = ((values >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    minima = np.full(len(listed) * bins, EMPTY, U)
    np.minimum.at(minima, owner * bins + slot, values)
    return minima.reshape(len(listed), bins)


def counts(listed: list[str]) -> np.ndarray:
    """(lines, PARTS) numbers of different shingles whose hash falls into each part."""
    return np.concatenate([np.zeros((0, PARTS), np.int64), *map(_counts, _slices(listed))])


def _counts(listed: list[str]) -> np.ndarray:
    owner, values = _hashed(listed)
    # The line above the upper bits of the hash, so that one sort does.
    cut = U(len(listed).bit_length())
    keys = np.sort(owner.astype(U) << (U(64) - cut) | values >> cut)
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    slot = (keys >> (U(64) - cut)) * U(PARTS) + (keys << cut >> (U(64) - U(PARTS.bit_length() - 1)))
    return np.bincount(slot.astype(np.int64), minlength=len(listed) * PARTS).reshape(len(listed), PARTS)


def _sets(listed: list[str], share: int = 0, shares: int = 1) -> Iterator[np.ndarray]:
    """Sorted hashes of the shingles of every line, those of one share of the hash range."""
    for part in _slices(listed):
        owner, values = _hashed(part)
        mine = values % U(shares) == U(share) if shares > 1 else slice(None)
        for own in np.split(values[mine], np.searchsorted(owner[mine], np.arange(1, len(part)))):
            own.sort()
            yield own[np.concatenate((own[:1] == own[:1], own[1:] != own[:-1]))]


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles any two of the sets share."""
    n = len(sets)
    common = np.zeros((n, n))
    if n <= FEW:
        for i in range(n):
            for j in range(i):
                both = np.concatenate((sets[i], sets[j]))
                both.sort()
                common[i, j] = common[j, i] = np.count_nonzero(both[1:] == both[:-1])
        return common
    values, row = np.concatenate(sets), np.repeat(np.arange(n), list(map(len, sets)))
    if not len(values):
        return common
    order = np.argsort(values)
    values, row = values[order], row[order]
    start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    times = np.diff(np.append(start, len(values)))
    # Shingles of the same lines are one column, named by the sum of hashes of its lines.
    names = np.add.reduceat(mix(np.arange(1, n + 1, dtype=U))[row], start)
    several = np.flatnonzero(times > 1)
    _, first, weight = np.unique(names[several], return_index=True, return_counts=True)
    first = several[first]
    for at in range(0, len(first), COLUMNS):
        begin, long = start[first[at : at + COLUMNS]], times[first[at : at + COLUMNS]]
        places = np.repeat(begin - np.cumsum(long) + long, long) + np.arange(long.sum())
        matrix = np.zeros((n, len(begin)), np.float32)
        matrix[row[places], np.repeat(np.arange(len(begin)), long)] = 1
        common += (matrix * weight[at : at + COLUMNS].astype(np.float32)) @ matrix.T
    return common


def _joined(ids: list[int], common: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs that join all similar lines, one a line at most."""
    near = common >= SIMILAR * (sizes[:, None] + sizes - common) - 1e-6
    np.fill_diagonal(near, False)
    left = near.any(axis=1)
    while left.any():
        seed = int(np.argmax(left))
        left[seed] = False
        fresh = np.array([seed])
        while len(fresh):
            fresh = np.flatnonzero(near[fresh].any(axis=0) & left)
            left[fresh] = False
            yield from ((ids[seed], ids[i]) for i in fresh)


def links(cells: list[dict[int, str]]) -> Iterator[tuple[int, int]]:
    """Pairs that join all similar lines of each cell, one a line at most."""
    small = [c for c in cells if sum(map(len, c.values())) <= HELD]
    sets = _sets([x for c in small for x in c.values()])
    for cell in small:
        own = [next(sets) for _ in cell]
        yield from _joined(list(cell), _common(own), np.array(list(map(len, own))))
    for cell in (c for c in cells if sum(map(len, c.values())) > HELD):
        common, sizes = np.zeros((len(cell), len(cell))), np.zeros(len(cell), np.int64)
        shares = 1 + sum(map(len, cell.values())) // HELD
        for share in range(shares):
            own = list(_sets(list(cell.values()), share, shares))
            common += _common(own)
            sizes += list(map(len, own))
        yield from _joined(list(cell), common, sizes)


def _id(line: str | bytes) -> tuple[int, int]:
    """128-bit hash of a line or text as two signed numbers; the first names a line in links."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(line))


def _banded(docs: DataFrame, parts: int) -> DataFrame:
    """(part, bucket, line) for every different line of every batch; a row lists many buckets of one part."""
    def dealt(made: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        bucket, line = np.concatenate(made).ravel(), np.repeat(np.array(ids, np.int64), BANDS)
        part = (bucket % U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        bounds = pa.array(np.append(start, len(part)).astype(np.int32))
        listed = (pa.ListArray.from_arrays(bounds, pa.array(x[order])) for x in (bucket.view(np.int64), line))
        return pa.RecordBatch.from_arrays([pa.array(part[start]), *listed], ["part", "bucket", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[np.ndarray] = []
        ids: list[int] = []
        for batch in batches:
            waiting: dict[int, str] = {}
            held = 0
            for text in [*_column(batch, "text").to_pylist(), None]:
                for _, line in lines(text):
                    held += 0 if waiting.setdefault(_id(line)[0], line) is not line else len(line)
                if waiting and (held >= CHUNK or text is None):
                    made.append(bands(list(waiting.values())))
                    ids += waiting
                    waiting, held = {}, 0
            if len(ids) * BANDS >= DEAL:
                yield dealt(made, ids)
                made, ids = [], []
        if ids:
            yield dealt(made, ids)

    return docs.mapInArrow(run, "part int, bucket array<long>, line array<long>")


def _starred(dealt: DataFrame) -> DataFrame:
    """(rep, line) for lines in a bucket with other lines, rep the smallest of them; a part comes to one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, 0), np.int64), *(np.stack([_column(b, c).flatten().to_numpy() for c in ("bucket", "line")]) for b in batches)]
        bucket, line = np.concatenate(held, axis=1)
        held.clear()
        order = np.argsort(bucket)
        bucket, line = bucket[order], line[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1])))
        rep = np.repeat(np.minimum.reduceat(line, start), np.diff(np.append(start, len(line)))) if len(start) else line
        other = np.flatnonzero(rep != line)
        for at in range(0, len(other), OUT):
            some = other[at : at + OUT]
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(line[some])], ["rep", "line"])

    return dealt.mapInArrow(run, "rep long, line long")


def _named(docs: DataFrame) -> DataFrame:
    """Replace ``text`` by its compressed form, for the way through a shuffle, and add its hash as __k1 and __k2."""
    schema = docs.withColumns({"text": F.col("text").cast("binary"), "__k1": F.lit(0).cast("long"), "__k2": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [t or b"" for t in _column(batch, "text").cast(pa.binary()).to_pylist()]
            keys = np.array([_id(t) for t in texts], np.int64).reshape(len(texts), 2)
            held = pa.array(map(pack.compress, texts), pa.binary())
            columns = [held if n == "text" else batch.column(i) for i, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], [*batch.schema.names, "__k1", "__k2"])

    return docs.mapInArrow(run, schema)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(line, more, doc_id, k1, k2, no) for every line."""
    schema = docs.select(*(F.lit(0).cast("long").alias(c) for c in ("line", "more")), "doc_id", *(F.lit(0).cast("long").alias(c) for c in ("k1", "k2")), F.lit(0).alias("no")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, text in enumerate(_column(batch, "text").to_pylist()):
                key = _id(text)
                found += [(row, no, *_id(line), *key) for no, line in lines(text)]
            row, no, line, more, k1, k2 = zip(*found, strict=True) if found else ((),) * 6
            longs = [pa.array(x, pa.int64()) for x in (line, more, k1, k2)]
            columns = [*longs[:2], _column(batch, "doc_id").take(pa.array(row, pa.int64())), *longs[2:], pa.array(no, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["line", "more", "doc_id", "k1", "k2", "no"])

    return docs.mapInArrow(run, schema)


def _dealt(joined: DataFrame) -> DataFrame:
    """(rep, lo, hi, line, text): the lines that a document's ``want`` names, in every cell of their groups.

    Of a group's blocks lo and hi meet in a cell.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, want in zip(_unpacked(batch), _column(batch, "want").to_pylist(), strict=True):
                own = text.decode().split("\n")
                for w in want:
                    for g in w["groups"]:
                        rows += [(g["rep"], min(g["own"], i), max(g["own"], i), w["line"], own[w["no"]]) for i in range(g["blocks"])]
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rep", "lo", "hi", "line", "text"])

    return joined.mapInArrow(run, "rep long, lo int, hi int, line long, text string")


def _linked(cells: DataFrame) -> DataFrame:
    """(a, b): links that join all similar lines of every cell; rows come sorted by cell."""
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(_column(batch, c).to_pylist() for c in ("rep", "lo", "hi", "line", "text")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict[int, str]] = []
        held = 0
        for _, cell in chain(groupby(rows(batches), key=lambda r: r[:3]), [(None, ())]):
            # Equal documents give a line once each.
            own = {r[3]: r[4] for r in cell}
            if len(own) > 1:
                waiting.append(own)
                held += sum(map(len, own.values()))
            if held >= SLICE or not own:
                found = zip(*links(waiting), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(found) or ((), ())], ["a", "b"])
                waiting, held = [], 0

    return cells.mapInArrow(run, "a long, b long")


def line_classes(docs: DataFrame, found: DataFrame, packed: DataFrame) -> DataFrame:
    """(line, root) for lines that have a near duplicate."""
    # As many parts as keep a task's rows few, however many lines there are.
    parts = 1 + found.count() * BANDS // DEAL
    pairs = saved(_starred(_banded(docs, 8 * parts).repartition(parts, "part")).distinct())
    groups = pairs.groupBy("rep").agg(F.ceil((F.count(F.lit(1)) + 1) / BLOCK).cast("int").alias("blocks"))
    members = pairs.unionByName(pairs.select("rep", F.col("rep").alias("line")).distinct()).join(groups, "rep")
    group = F.struct("rep", "blocks", F.pmod(F.xxhash64("line", "rep"), "blocks").cast("int").alias("own"))
    # A line is in twelve groups at most.
    wanted = saved(members.groupBy("line").agg(F.collect_list(group).alias("groups")))
    at = found.join(wanted.select("line"), "line").groupBy("line").agg(F.min(F.struct("k1", "k2", "no")).alias("at"))
    want = at.join(wanted, "line").groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("line", "at.no", "groups")).alias("want"))
    cells = _dealt(packed.join(want, ["k1", "k2"]).select("text", "want"))
    linked = _linked(cells.repartition("rep", "lo", "hi").sortWithinPartitions("rep", "lo", "hi"))
    return components(linked).select(F.col("node").alias("line"), "root").distinct()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns but the text, with n_lines (not blank), n_removed and kept, the text that stays."""
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_removed", "kept")]
    own = docs.select(*others, whole(text).alias("text"))
    found = saved(_occurrences(own.select(F.col(key).alias("doc_id"), "text")))
    packed = _named(own.select("text")).withColumnsRenamed({"__k1": "k1", "__k2": "k2"})
    classes = saved(line_classes(own.select("text"), found, packed))

    place = F.min(F.struct("doc_id", "k1", "k2", "no"))
    # Most lines occur once and resemble none; only the others are put in order.
    times = found.groupBy("line", "more").agg(F.count(F.lit(1)).alias("n")).join(classes.hint("shuffle_hash"), "line", "left")
    several = saved(times.where("n > 1 OR root IS NOT NULL").drop("n"))
    few = saved(found.join(several.hint("shuffle_hash"), ["line", "more"]))
    firsts = few.groupBy("line", "more").agg(place.alias("first")).join(several, ["line", "more"])
    keepers = firsts.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("keeper"))
    again = firsts.join(keepers, "root", "left").select("line", "more", F.coalesce("keeper", "first").alias("keeper"))
    gone = few.join(again, ["line", "more"]).where(F.struct("doc_id", "k1", "k2", "no") != F.col("keeper"))
    cut = saved(gone.select("doc_id", "k1", "k2", "no").distinct().groupBy("doc_id", "k1", "k2").agg(F.collect_list("no").alias("gone")))
    cut = cut.withColumnsRenamed({"doc_id": "__id", "k1": "__c1", "k2": "__c2", "gone": "__gone"})
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.col("__k1") == F.col("__c1")) & (F.col("__k2") == F.col("__c2"))
    joined = _named(own).join(cut, same, "left").select(*others, "text", "__gone")
    schema = joined.select(*others, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for own, gone_ in zip(_unpacked(batch), _column(batch, "__gone").to_pylist(), strict=True):
                whole_, without = own.decode(), set(gone_ or ())
                sizes.append(len(lines(whole_)))
                removed.append(len(without))
                kept.append("\n".join(x for i, x in enumerate(whole_.split("\n")) if i not in without) if without else whole_)
            columns = [*(_column(batch, n) for n in others), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "n_lines", "n_removed", "kept"])

    return joined.mapInArrow(run, schema)
