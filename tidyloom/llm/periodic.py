"""Periodic runs of words, found in tiles and stitched together.

A run is a stretch of words with smallest period q, at least ``EXPONENT`` periods and
``LEAST`` words long, that no neighbouring word extends. Periods are looked for by octave: for the
octave from s to 2 s - 1, boundaries lie s words apart, and every run has a boundary b at
which the 2 s words from b on equal the 2 s words from b + q on. Equal hashes of such grams name
the pairs of boundary and period; there the words themselves are compared to the right
and to the left, as a Z-function does it from either side of a boundary, which gives the
stretch as far as the tile reaches.

A text of up to ``INLINE`` bytes is one tile. A longer text is exploded into overlapping tiles
for each group of octaves, which are dealt out over the cluster and solved by themselves. A
tile overlaps its neighbours by eight of the largest steps, so fragments of one
run overlap by a period at least: fragments are shuffled by text and period, and those that
overlap so are one stretch. Of stretches with the same ends the one with the smallest
period remains; its multiples are no smallest periods.

Texts are known by a 128-bit hash, words inside them by 64-bit hashes. A long text
costs n log n steps, spread over its tiles.

Defined cases: null and empty texts have no words and no runs; equal texts have equal
results; other columns stay, unless they have the name of a result; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.llm import tokens
from tidyloom.llm.common import saved, whole, words

EXPONENT = 4
LEAST = 6
#: Bytes of the longest text that is a single tile.
INLINE = 1 << 17
#: Words between the starts of the tiles of the first group of octaves, and octaves in a group. Each later group has tiles
#: larger by the octaves before it.
CORE = 1 << 13
GROUP = 9
LATER = 4

#: One fragment: period, first word, word after the last.
FRAGMENTS = "array<struct<p: long, s: long, e: long>>"
RESULTS = ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def octaves(n: int) -> int:
    """Number of octaves in which a text of n words can have a run."""
    return max(0, (n // EXPONENT).bit_length())


def _same_right(x: np.ndarray, a: int, b: int) -> int:
    """Words from a on that equal those from b on (a < b): the Z-value of b - a at the boundary a."""
    n, at, step = len(x) - b, 0, 64
    while at < n:
        until = min(n, at + step)
        differ = np.flatnonzero(x[a + at : a + until] != x[b + at : b + until])
        if len(differ):
            return at + int(differ[0])
        at, step = until, step * 2
    return n


def _same_left(x: np.ndarray, a: int, b: int) -> int:
    """Words before a that equal those before b (a < b), counted from the boundary to the left."""
    at, step = 0, 64
    while at < a:
        until = min(a, at + step)
        differ = np.flatnonzero(x[a - until : a - at][::-1] != x[b - until : b - at][::-1])
        if len(differ):
            return at + int(differ[0])
        at, step = until, step * 2
    return a


def _primitive(x: np.ndarray, at: int, p: int) -> bool:
    """Whether the p words from ``at`` on are no repetition of fewer."""
    rest, r, primes = p, 2, []
    while r * r <= rest:
        if rest % r == 0:
            primes.append(r)
            while rest % r == 0:
                rest //= r
        r += 1
    if rest > 1:
        primes.append(rest)
    return not any(_same_right(x[at : at + p], 0, p // r) == p - p // r for r in primes)


def _candidates(grams: np.ndarray, starts: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries and periods of one octave whose grams agree; in blocks, so that memory is bounded."""
    found_b, found_p = [], []
    block = max(1, (1 << 20) // s)
    offsets = np.arange(s, 2 * s)
    for at in range(0, len(starts), block):
        b = starts[at : at + block]
        row, column = np.nonzero(grams[b][:, None] == grams[b[:, None] + offsets])
        found_b.append(b[row])
        found_p.append(column + s)
    return (np.concatenate(found_b), np.concatenate(found_p)) if found_b else (np.zeros(0, int), np.zeros(0, int))


def solve(hashes: np.ndarray, bounds: np.ndarray, last: int) -> list[tuple[int, int, int, int]]:
    """(text, period, start, end) of every stretch with a primitive period in the octaves before ``last``.

    ``bounds`` has the first word of every text (or tile) and closes the last; starts and ends are counted in the text.
    Small periods come first, since their stretches name the multiples that need no look.
    """
    n = len(hashes)
    sums = tokens.Sequences(hashes)
    sizes = np.diff(bounds)
    #: Per word the end of the furthest stretch over it, and the period of that.
    reach, root = np.zeros(n, np.int64), np.ones(n, np.int64)
    out = []
    for octave in range(last):
        s = 1 << octave
        long = np.flatnonzero(sizes >= EXPONENT * s)
        if not len(long):
            break
        grams = sums.hash(np.arange(max(0, n - 2 * s + 1)), 2 * s)
        # A gram at b and one at b + 2 s - 1 must lie inside the text.
        count = np.maximum(0, (sizes[long] - (4 * s - 1)) // s + 1)
        # Close to the end of a text not all periods have room; those boundaries are looked at one period at a time.
        text = np.repeat(long, count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        b, p = _candidates(grams, bounds[text] + within * s, s)
        tail_b, tail_p = [], []
        for extra in range(3):
            # The boundaries after the last one with room, while b + p + 2 s still fits.
            at = bounds[long] + (count + extra) * s
            room = bounds[long + 1] - at - 2 * s
            near = np.flatnonzero(room >= s)
            if len(near):
                width = np.minimum(room[near] - s + 1, s)
                start = np.repeat(at[near], width)
                period = s + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                same = grams[start] == grams[start + period]
                tail_b.append(start[same])
                tail_p.append(period[same])
        b, p = np.concatenate([b, *tail_b]), np.concatenate([p, *tail_p])
        if not len(b):
            continue
        known = (reach[b] >= b + p + 2 * s) & (p % root[b] == 0)
        b, p = b[~known], p[~known]
        order = np.lexsort((p, b))
        for at, period in zip(b[order].tolist(), p[order].tolist(), strict=True):
            if reach[at] >= at + period + 2 * s and period % root[at] == 0:
                continue
            doc = int(np.searchsorted(bounds, at, "right")) - 1
            low, high = int(bounds[doc]), int(bounds[doc + 1])
            x = hashes[low:high]
            right = _same_right(x, at - low, at - low + period)
            start = at - low - _same_left(x, at - low, at - low + period)
            end = at - low + period + right
            if right < 2 * s or not _primitive(x, at - low, period):
                continue
            out.append((doc, period, start, end))
            over = slice(low + start, low + end)
            further = reach[over] < low + end
            root[over][further] = period
            reach[over][further] = low + end
    return out


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _fragments(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    offsets = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
    flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 3)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["p", "s", "e"])
    )


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return _column(batch, "text").cast(pa.binary()).to_pylist()


def _scanned(docs: DataFrame, inline: bool, keep: bool) -> DataFrame:
    """Replace ``text`` by n_words, fragments, the digest of its words, and where runs are possible or asked for the packed text."""
    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(
        *others, F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(FRAGMENTS).alias("fragments"),
        F.lit("").alias("plain"), F.lit(None).cast("binary").alias("packed"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = _texts(batch)
            found: list[list] = [[] for _ in texts]
            if inline:
                for part in tokens.words(texts):
                    sizes = np.diff(part.bounds)
                    for doc, p, s, e in solve(part.hash, part.bounds, octaves(int(sizes.max(initial=0)))):
                        found[part.first + doc].append((p, s, e))
            own = [(t or b"").split() for t in texts]
            digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in own]
            packed = [pack.compress(t or b"") if keep or not inline or f else None for t, f in zip(texts, found, strict=True)]
            columns = [_column(batch, c) for c in others]
            columns += [pa.array(map(len, own), pa.int64()), _fragments(found), pa.array(digests), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "n_words", "fragments", "plain", "packed"])

    return docs.mapInArrow(run, schema)


def tiles_of(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(first octave, octave after the last, first word, word after the last) of the tiles of a text of n words."""
    first, last, core = 0, GROUP, CORE
    while first < octaves(n):
        margin = 8 << (last - 1)
        for at in range(0, n, core):
            yield first, last, max(0, at - margin), min(n, at + core + margin)
        first, last, core = last, last + LATER, core << LATER


def _tiles(docs: DataFrame) -> DataFrame:
    """(k1, k2, first, last, at, words) for every tile of every text; words are hashes of 8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = _column(batch, "k1"), _column(batch, "k2")
            for part in tokens.words(_texts(batch)):
                for doc in range(part.texts):
                    own = part.hash[part.bounds[doc] : part.bounds[doc + 1]]
                    for first, last, start, end in tiles_of(len(own)):
                        row = part.first + doc
                        yield pa.RecordBatch.from_arrays(
                            [k1[row : row + 1], k2[row : row + 1], pa.array([first], pa.int32()), pa.array([last], pa.int32()),
                             pa.array([start], pa.int64()), pa.array([own[start:end].tobytes()], pa.binary())],
                            ["k1", "k2", "first", "last", "at", "words"],
                        )

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, first int, last int, at long, words binary")


def _solved(tiles: DataFrame) -> DataFrame:
    """(k1, k2, p, s, e) for every fragment of every tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, first, last, at, packed = (_column(batch, c).to_pylist() for c in ("k1", "k2", "first", "last", "at", "words"))
            rows = []
            for i, hashes in enumerate(packed):
                x = np.frombuffer(hashes, np.uint64)
                found = solve(x, np.array([0, len(x)]), last[i])
                rows += [(k1[i], k2[i], p, s + at[i], e + at[i]) for _, p, s, e in found if p >> first[i]]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["k1", "k2", "p", "s", "e"])

    return tiles.mapInArrow(run, "k1 long, k2 long, p long, s long, e long")


def _stitched(fragments: DataFrame) -> DataFrame:
    """(k1, k2, runs) with the runs of every text that has any: structs of start, length, period by start and period."""
    order = Window.partitionBy("k1", "k2", "p").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Fragments of one stretch overlap by a period; different stretches of one period overlap by less.
    new = F.when(before - F.col("s") >= F.col("p"), 0).otherwise(1)
    parts = fragments.distinct().withColumn("new", new).withColumn("part", F.sum("new").over(order))
    stretches = parts.groupBy("k1", "k2", "p", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    stretches = stretches.where((F.col("e") - F.col("s") >= LEAST) & (F.col("e") - F.col("s") >= EXPONENT * F.col("p")))
    runs = stretches.groupBy("k1", "k2", "s", "e").agg(F.min("p").alias("p"))
    run = F.struct(F.col("s").alias("start"), (F.col("e") - F.col("s")).alias("length"), F.col("p").alias("period"))
    return runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(run)).alias("runs"))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of equals the first, then the one with the smallest period."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    return best


def collapsed(own: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats."""
    keep = np.ones(len(own), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [own[i] for i in np.flatnonzero(keep).tolist()]


def _finished(rows: DataFrame, keep: bool) -> DataFrame:
    """Results of rows with packed texts and their runs."""
    others = [c for c in rows.columns if c not in ("k1", "k2", "fragments", "plain", "packed", "runs", "n_words")]
    made = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"
    names = [c.split()[0] for c in made.split(", ")]
    schema = rows.select(*others, *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in made.split(", "))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, found in zip(_column(batch, "packed").to_pylist(), _column(batch, "runs").to_pylist(), strict=True):
                own = unpack.decompress(packed).split() if packed else []
                runs = [(r["start"], r["length"], r["period"]) for r in found or []]
                best = strongest(runs)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                left = b" ".join(collapsed(own, runs))
                out.append((
                    len(own), len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                    hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest(), left.decode() if keep else None,
                ))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            kinds = [pa.int64()] * 6 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays(
                [*(_column(batch, c) for c in others), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*others, *names]
            )

    return rows.mapInArrow(run, schema)


def runs(docs: DataFrame, text: str = "text", keep: bool = True, inline: int = INLINE) -> DataFrame:
    """All columns but the text, with n_words, n_runs, the strongest run, digests and (``keep``) the collapsed text."""
    others = [c for c in docs.columns if c not in (text, "collapsed", *RESULTS)]
    inner = {c: f"__c{i}" for i, c in enumerate(others)}
    digest = F.md5(F.encode(whole(text), "UTF-8"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    keyed = docs.select(*(F.col(c).alias(n) for c, n in inner.items()), half(1).alias("k1"), half(17).alias("k2"), whole(text).alias("text"))
    short, long = keyed.where(F.octet_length("text") <= inline), keyed.where(F.octet_length("text") > inline)
    rows = saved(_scanned(short, True, keep).unionByName(_scanned(long, False, keep)))
    tiled = _solved(_tiles(long.select("k1", "k2", "text").dropDuplicates(["k1", "k2"])).repartition("k1", "k2", "first", "at"))
    inside = rows.where(F.size("fragments") > 0).select("k1", "k2", F.explode("fragments").alias("f")).select("k1", "k2", "f.*")
    found = saved(_stitched(inside.unionByName(tiled)))
    open_rows = rows.where("packed IS NOT NULL")
    mended = _finished(open_rows.join(found, ["k1", "k2"], "left"), keep)
    empty = hashlib.sha256().hexdigest()
    none = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    clean = rows.where("packed IS NULL").select(
        *inner.values(), "n_words", F.lit(0).cast("long").alias("n_runs"), *none, F.lit(empty).alias("runs_sha256"),
        F.col("plain").alias("collapsed_sha256"), F.lit(None).cast("string").alias("collapsed"),
    )
    out = mended.select(clean.columns).unionByName(clean)
    return (out if keep else out.drop("collapsed")).withColumnsRenamed({n: c for c, n in inner.items()})


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a periodic stretch in every tenth text, placed by the checksum of the id; null ids are left alone."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    listed = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words("text")))
    size, g = F.size("w"), F.floor(F.col("h") / 10)
    listed = listed.withColumns({"n": size, "g": g})
    listed = listed.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    listed = listed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    return listed.select("doc_id", F.when(F.col("a").isNotNull(), _repeated()).otherwise(F.col("text")).alias("text"))


def _repeated() -> Column:
    """Words w with those from a on replaced by repetitions of the first p of them."""
    a, p, n = F.col("a").cast("int"), F.col("p"), F.col("n")
    head = F.slice("w", F.lit(1), a)
    unit = F.array_join(F.slice("w", a + 1, p), " ")
    times = F.floor((n - a) / p).cast("int")
    rest = F.slice("w", a + 1, F.pmod(n - a, p))
    tail = F.array_repeat(unit, times)
    return F.array_join(F.concat(head, tail, rest), " ")
