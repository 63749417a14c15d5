"""Benchmark passages in training documents, found with an FM-index per training shard.

Every task cuts its documents into shards, indexes a shard's words and searches all
benchmark windows in it by backward search; located windows are merged to spans of words.
Only words that the benchmark has get symbols, and runs of them shorter than the
shortest window are left out, since nothing can be found there.

The benchmark travels to the tasks in slices of bounded size, one pass for each, so
neither its size nor the number of its items is limited.

Defined cases: null and empty texts have no words and are clean; benchmark items without
words find nothing; items with a null id remove words but are not listed; repeated items
count once; equal documents get equal results; a benchmark without rows leaves all
documents clean. Columns of the input with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import whole
from tidyloom.llm.fm_index import FmIndex

WINDOW = 13
#: Bytes of benchmark text that travel to the tasks at once.
SLICE = 16 << 20
#: Symbols of a training shard; a longer document is a shard of its own.
SHARD = 1 << 19
#: Symbols: 0 ends a shard, then the mark between two runs, then the words.
BREAK, FIRST = 1, 2
#: A document is contaminated if one word in so many is hit.
SHARE = 20

#: Lower-cases A-Z and blanks every ASCII character that is neither a letter nor a digit.
WORDS = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)

Phrases = tuple[dict[bytes, int], list[tuple[np.ndarray, list[list[str]]]], int]


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


def phrases(items: list[tuple[str | None, str | None]], window: int) -> Phrases:
    """Vocabulary, then per length the distinct windows and their items, and the shortest length."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for name, text in items:
        own = [vocabulary.setdefault(w, len(vocabulary) + FIRST) for w in split((text or "").encode())]
        size = min(window, len(own))
        for at in range(len(own) - size + 1 if own else 0):
            listed = owners.setdefault(tuple(own[at : at + size]), set())
            if name is not None:
                listed.add(name)
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for phrase in owners:
        by_length.setdefault(len(phrase), []).append(phrase)
    groups = [(np.array(p, np.int64), [sorted(owners[x]) for x in p]) for p in by_length.values()]
    return vocabulary, groups, min(by_length, default=window)


def _runs(symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of known words that a window fits into."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], symbols > 0, [0])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= shortest
    return starts[long], ends[long]


def _search(texts: list[np.ndarray], groups: list) -> tuple[np.ndarray, list[tuple[int, list[str]]]]:
    """Which symbols of the joined runs are covered, and (place, items) of what was found."""
    joined = np.concatenate([*texts, [0]])
    index = FmIndex(joined)
    change = np.zeros(len(joined) + 1, np.int64)
    found = []
    for windows, owners in groups:
        low, high = index.search(windows)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        times = high[hit] - low[hit]
        rows = np.repeat(low[hit] - np.cumsum(times) + times, times) + np.arange(times.sum())
        places = index.locate(rows)
        change += np.bincount(places, minlength=len(change)) - np.bincount(places + windows.shape[1], minlength=len(change))
        found += zip(places.tolist(), (owners[i] for i in np.repeat(hit, times).tolist()), strict=True)
    return np.cumsum(change[:-1]) > 0, found


def hits(texts: list[bytes | None], known: Phrases) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Words, merged spans of hit words and found items of every text, shard by shard."""
    vocabulary, groups, shortest = known
    results: list[tuple[int, list[tuple[int, int]], set[str]]] = []
    waiting: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if waiting:
            covered, found = _search([w[2] for w in waiting], groups)
            firsts = np.cumsum([0] + [len(w[2]) for w in waiting])
            edges = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0])).astype(np.int8))).reshape(-1, 2)
            for (start, end), run in zip(edges.tolist(), (np.searchsorted(firsts, edges[:, 0], "right") - 1).tolist(), strict=True):
                doc, offset, _ = waiting[run]
                shift = offset - int(firsts[run])
                results[doc][1].append((start + shift, end + shift))
            runs = np.searchsorted(firsts, [p for p, _ in found], "right") - 1
            for (_, names), run in zip(found, runs.tolist(), strict=True):
                results[waiting[run][0]][2].update(names)
        waiting.clear()
        held = 0

    for doc, text in enumerate(texts):
        listed = split(text)
        results.append((len(listed), [], set()))
        if len(listed) < shortest or not vocabulary:
            continue
        symbols = np.fromiter((vocabulary.get(w, 0) for w in listed), np.int64, len(listed))
        for start, end in zip(*(x.tolist() for x in _runs(symbols, shortest)), strict=True):
            waiting.append((doc, start, np.concatenate((symbols[start:end], [BREAK]))))
            held += end - start + 1
        if held >= SHARD:
            flush()
    flush()
    return results


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


SPANS = "array<struct<start:int,end:int>>"


def _pass(docs: DataFrame, known: Phrases, text: str) -> DataFrame:
    """Add what one slice finds to the spans and items that earlier slices found."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in (text, "n_words", "spans", "items")}
            found = hits(batch.column(at[text]).cast(pa.binary()).to_pylist(), known)
            columns = list(batch.columns)
            columns[at["n_words"]] = pa.array([f[0] for f in found], pa.int64())
            columns[at["spans"]] = pa.array([
                [{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in old] + f[1])]
                for old, f in zip(batch.column(at["spans"]).to_pylist(), found, strict=True)
            ], spans_type)
            columns[at["items"]] = pa.array([
                sorted(f[2].union(old)) for old, f in zip(batch.column(at["items"]).to_pylist(), found, strict=True)
            ], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> DataFrame:
    """All columns, with n_words, spans of hit words, items found, n_hit, n_items and contaminated."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.octet_length(whole("text")))).first()[0] or 0
    slices = -(-size // SLICE) or 1
    found = docs.withColumns({
        "n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<string>"),
    })
    for part in range(slices):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == part)
        found = _pass(found, phrases([tuple(r) for r in own.distinct().collect()], window), text)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words"))
    )


def without(judged: DataFrame, text: str = "text") -> DataFrame:
    """Cut the hit words out of the texts of a judged table; other texts stay as they are."""
    word = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
    cut = F.concat_ws("", F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int")),
        lambda i: F.concat(F.get("__between", i), F.when(
            F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])), F.lit("")
        ).otherwise(F.coalesce(F.get("__words", i), F.lit("")))),
    ))
    parts = judged.withColumns({"__between": F.split(text, word, -1), "__words": F.regexp_extract_all(text, F.lit(word), F.lit(0))})
    return parts.withColumn(text, F.when(F.size("spans") > 0, cut).otherwise(F.col(text))).drop("__between", "__words")
