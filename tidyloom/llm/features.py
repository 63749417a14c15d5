"""Hashed features of whole texts for linear models, the same in training and scoring.

A text is described by densities: of its words and of their beginnings, hashed to a
fixed number of buckets; and by the square roots of densities: of its byte values, which
tell shouting, symbols and markup, and of words that repeat the one before. All come from
sums over the text, so it is scored in one pass with one weight per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm import tokens
from tidyloom.llm.decontaminate import WORDS
from tidyloom.llm.tokens import U

#: Buckets for words and their beginnings; then the bytes, then repeated words.
BUCKETS = 1 << 16
SIZE = BUCKETS + 256 + 1
#: Lengths in bytes of the beginnings.
HEADS = (4, 5, 6)


def _places(found: tokens.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, buckets) for the words, then for each length of their beginnings."""
    array = np.frombuffer(found.data, np.uint8)
    yield np.arange(len(found.hash)), (found.hash % U(BUCKETS)).astype(np.int64)
    for size in HEADS:
        own = np.flatnonzero(found.end - found.start >= size)
        packed = np.full(len(own), size, U)
        for k in range(size):
            packed = packed << U(8) | array[found.start[own] + k].astype(U)
        yield own, (tokens.mix(packed) % U(BUCKETS)).astype(np.int64)


def _repeats(found: tokens.Words) -> np.ndarray:
    """Per text, the number of words equal to the one before."""
    same = (found.hash[1:] == found.hash[:-1]) & (found.doc[1:] == found.doc[:-1])
    return np.bincount(found.doc[1:][same], minlength=found.texts)


def _chunks(texts: list[bytes | None]) -> Iterator[tokens.Words]:
    return tokens.words([(t or b"").translate(WORDS) for t in texts])


def _bytes(text: bytes | None) -> np.ndarray:
    counts = np.bincount(np.frombuffer(text or b"", np.uint8), minlength=256)
    return np.sqrt(counts / max(1, len(text or b"")))


def vectors(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and densities of every text in order."""
    for found in _chunks(texts):
        keys = np.concatenate([found.doc[own] * BUCKETS + bucket for own, bucket in _places(found)])
        keys, counts = np.unique(keys, return_counts=True)
        bounds = np.searchsorted(keys, np.arange(found.texts + 1) * BUCKETS)
        words, repeats = np.maximum(1, np.diff(found.bounds)), _repeats(found)
        for d in range(found.texts):
            at = slice(bounds[d], bounds[d + 1])
            bytes_ = _bytes(texts[found.first + d])
            some = np.flatnonzero(bytes_)
            yield (
                np.concatenate((keys[at] % BUCKETS, BUCKETS + some, [SIZE - 1])),
                np.concatenate((counts[at] / words[d], bytes_[some], [np.sqrt(repeats[d] / words[d])])),
            )


def scores(texts: list[bytes | None], weights: np.ndarray) -> np.ndarray:
    """(texts, models) weighted sums of the densities, for weights of shape (SIZE, models)."""
    out = np.zeros((len(texts), weights.shape[1]))
    for found in _chunks(texts):
        own = slice(found.first, found.first + found.texts)
        words = np.maximum(1, np.diff(found.bounds))
        for m in range(weights.shape[1]):
            total = np.zeros(found.texts)
            for word, bucket in _places(found):
                total += np.bincount(found.doc[word], weights[bucket, m], minlength=found.texts)
            out[own, m] = total / words + np.sqrt(_repeats(found) / words) * weights[SIZE - 1, m]
    if len(texts):
        out += np.stack([_bytes(t) for t in texts]) @ weights[BUCKETS : BUCKETS + 256]
    return out


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, rows: int, marks: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Features of at most ``rows`` labelled documents, chosen by a hash of their key.

    Returns the marks of each document, and for all features the document, index and
    density. Only the chosen keys are broadcast, and a key that several documents have counts
    once, with the least of their texts, so the bound is ``rows``.
    """
    # Of labels that contradict each other the larger marks count, on every run.
    single = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*marks)).alias("m")).select(key, "m.*")
    chosen = single.orderBy(F.xxhash64(key), key).limit(rows)
    joined = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)
    # Combined in the map tasks, so a hot key is one row for each of them.
    joined = joined.groupBy(key, *marks).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            made = list(vectors(batch.column(at).cast(pa.binary()).to_pylist()))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (key, *marks)]
            columns += [pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [key, *marks, "at", "value"])

    schema = joined.select(key, *marks, F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("value")).schema
    found = sorted(joined.mapInArrow(run, schema).collect(), key=lambda r: (r[0], r["at"], r["value"]))
    at = [np.frombuffer(r["at"], "<i4") for r in found]
    row = np.repeat(np.arange(len(found), dtype=np.int32), [len(a) for a in at])
    none = np.zeros(0, np.float32)
    return (
        [tuple(r[m] for m in marks) for r in found], row,
        np.concatenate(at) if at else none.astype(np.int32),
        np.concatenate([np.frombuffer(r["value"], "<f4") for r in found]) if found else none,
    )


class Selected:
    """The features that tell most about a mark, scaled, as a dense matrix of a sample."""

    def __init__(self, rows: int, row: np.ndarray, at: np.ndarray, value: np.ndarray, mark: np.ndarray, most: int, damp: float, least: int = 5):
        often = np.bincount(at, minlength=SIZE)
        mean = np.bincount(at, value, minlength=SIZE) / max(1, rows)
        centred = (mark - mark.mean()).astype(np.float32)
        together = np.bincount(at, value * centred[row], minlength=SIZE)
        spread = np.sqrt(np.bincount(at, value**2, minlength=SIZE) * max(centred.var(), 1e-12)) + 1e-12
        telling = np.where(often >= least, np.abs(together / spread), 0)
        order = np.argsort(-telling, kind="stable")[:most]
        self.index = np.sort(order[telling[order] > 0])
        # Rare features are scaled up less than their rarity asks for, by ``damp``.
        self.scale = (1 / np.sqrt(mean[self.index] + damp)).astype(np.float32)
        column = np.full(SIZE, -1)
        column[self.index] = np.arange(len(self.index))
        mine = column[at] >= 0
        self.matrix = np.zeros((rows, len(self.index)), np.float32)
        self.matrix[row[mine], column[at[mine]]] = value[mine]
        self.matrix *= self.scale

    def weights(self, w: np.ndarray) -> np.ndarray:
        """Weights over all features for those of the matrix."""
        out = np.zeros(SIZE)
        out[self.index] = w * self.scale
        return out


def descend(gradient, start: np.ndarray, steps: int, rate: float = 0.05) -> np.ndarray:
    """Minimise by Adam; ``gradient`` maps parameters to the slope of the loss."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))
