"""Periodic runs against all stretches of all periods, in one tile and in many."""

import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F
from tests.llm import odd
from tidyloom.llm import periodic, tokens
from tidyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def brute(own):
    """(start, length, period) of all runs: maximal stretches of equal words p apart, the smallest period per stretch."""
    found, n = {}, len(own)
    x = np.unique(own, return_inverse=True)[1] if own else np.zeros(0, int)
    for p in range(1, n // 4 + 1):
        same = np.concatenate(([0], (x[:-p] == x[p:]).astype(int), [0]))
        edges = np.flatnonzero(np.diff(same))
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + p).tolist(), strict=True):
            if e - s >= max(6, 4 * p):
                found.setdefault((s, e - s), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def expected(text):
    own = odd.words(text)
    found = brute(own)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(own) if i not in drop)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (len(own), len(found), *best, milli, odd.sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), odd.sha(kept)), kept


def plant(doc_id, text):
    h, own = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, odd.words(text)
    if h % 10 or not own:
        return text
    n, g = len(own), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(own[i] if i < a else own[a + (i - a) % p] for i in range(n))


def periodic_texts():
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh")
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for p in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100):
        unit = [f"w{rng.randint(0, 3)}" for _ in range(p)]
        for k in (3 * p, 4 * p - 1, 4 * p, 4 * p + 1, 7 * p + p // 2):
            head, tail = [word() for _ in range(rng.randint(0, 9))], [word() for _ in range(rng.randint(0, 9))]
            texts.append(" ".join(head + [unit[i % p] for i in range(k)] + tail))
    texts += ["x " * 700, "a b " * 300 + "b a " * 200, ("a a b " * 5 + "c ") * 9, " ".join("ab"[int(i).bit_count() % 2] for i in range(900))]
    fibonacci = ["a", "a b"]
    while len(fibonacci[-1]) < 2500:
        fibonacci.append(f"{fibonacci[-1]} {fibonacci[-2]}")
    return [*texts, fibonacci[-1]]


def rows_of(df, *key):
    return Counter((*(r[k] for k in key), *(r[c] for c in COLUMNS)) for r in df.collect())


def test_solve_over_many_texts_at_once():
    texts = [t.encode() for t in periodic_texts()]
    for part in tokens.words(texts):
        found = [set() for _ in texts]
        for doc, p, s, e in periodic.solve(part.hash, part.bounds, periodic.octaves(int(np.diff(part.bounds).max()))):
            if e - s >= max(6, 4 * p):
                found[doc].add((s, e - s, p))
        assert [sorted(f) for f in found] == [brute(odd.words(t.decode())) for t in texts]


@pytest.mark.parametrize("tiled", [False, True])
def test_runs_in_one_tile_and_in_many(spark, monkeypatch, tiled):
    if tiled:
        monkeypatch.setattr(periodic, "CORE", 16)
        monkeypatch.setattr(periodic, "GROUP", 2)
        monkeypatch.setattr(periodic, "LATER", 1)
    texts = periodic_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in periodic.runs(df, inline=0 if tiled else periodic.INLINE).collect()}
    for i, text in enumerate(texts):
        numbers, kept = expected(text)
        assert tuple(got[i][c] for c in COLUMNS) == numbers, text
        assert got[i].collapsed == kept


def test_tiles_cover_every_octave():
    for n in (0, 3, 4, 100, 20_000, 700_000):
        tiles = list(periodic.tiles_of(n))
        for octave in range(periodic.octaves(n)):
            own = [t for t in tiles if t[0] <= octave < t[1]]
            assert own[0][2] == 0 and own[-1][3] == n
            assert all(a[3] - b[2] >= min(8 << octave, b[3] - b[2], a[3] - a[2]) for a, b in zip(own, own[1:], strict=False))


def test_awkward_documents(spark):
    rows = odd.texts()
    docs = odd.table(spark).drop("n_words")
    want = Counter((i, "x", *expected(t)[0]) for i, t, _ in rows)
    assert rows_of(periodic.runs(docs), "doc_id", "kept") == want
    small = periodic.runs(docs, keep=False, inline=2000)
    assert "collapsed" not in small.columns and rows_of(small, "doc_id", "kept") == want
    assert periodic.runs(odd.table(spark, [])).count() == 0


def test_planted_runs(spark):
    rows = odd.texts()
    got = Counter(tuple(r) for r in periodic.planted(odd.table(spark)).select("doc_id", F.col("text")).collect())
    assert got == Counter((i, plant(i, t)) for i, t, _ in rows)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((i, *expected(plant(i, t))[0][1:]) for i, t in rows)
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS[1:])) for r in QUERIES["op13_periodic"](spark, SF).collect())
    assert got == want and sum(n > 0 for _, n, *_ in got) > 5
