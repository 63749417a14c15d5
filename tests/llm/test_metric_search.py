"""Exact search by inner product against all products, and what the tree's bounds save."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from tidyloom.llm import metric_search
from tidyloom.llm.metric_search import Space, Tree, search

SCHEMA = "vec_id long, embedding array<float>, v string, id int, cell string, q int, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1, "y", 2, 0.5, 3) for i, e in rows], SCHEMA).repartition(3)


def brute(rows, every, k, scale=64):
    points = [
        (i, [math.floor(scale * float(x)) for x in e]) for i, e in rows
        if e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for at, (i, q) in enumerate(points):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j) for n, (j, v) in enumerate(points) if n != at]
        out += [(i, r, j, -s) for r, (s, _, j) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, every=20, k=20):
    out = metric_search.top_products(frame(spark, rows), F.col("vec_id") % every == 0, k)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, out.collect()), key=repr)


def clustered(rng, n, size=8, spread=0.05):
    centers = [[rng.gauss(0, 0.4) for _ in range(size)] for _ in range(6)]
    return [[float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(centers)] for _ in range(n)]


@pytest.mark.parametrize("tree", [4096, 32])
def test_many_trees_repeats_and_ties(spark, monkeypatch, tree):
    monkeypatch.setattr(metric_search, "TREE", tree)
    monkeypatch.setattr(metric_search, "PAGE", 8)
    monkeypatch.setattr(metric_search, "BLOCK", 7)
    rng = random.Random(4)
    rows = list(enumerate(clustered(rng, 400)))
    # A third of all rows are one vector; some rows repeat, some ids have several vectors, some have none.
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + rows[:30] + [(40, rows[7][1]), (40, rows[8][1])]
    rows += [(None, rows[5][1]), (None, rows[9][1]), (None, rows[9][1]), (-20, rows[3][1])]
    assert found(spark, rows) == brute(rows, 20, 20)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.25]), (20, None), (40, [nan, 1.0]), (60, [None, 1.0]), (80, [inf, 1.0]), (100, [1.0]), (120, []), (3, [1.0, 2.0, 3.0]),
        (4, [-0.01, -0.01]), (140, [0.0, -0.0]), (160, [1e6, -1e6]), (5, [1e6, 1e6]),
    ]
    assert found(spark, rows) == brute(rows, 20, 20)
    assert found(spark, []) == [] and found(spark, [(20, None)]) == [] and found(spark, [(20, [1.0])]) == []
    # Beyond the stated size a component counts as that size.
    huge = metric_search.top_products(frame(spark, [(0, [1e30, 1.0]), (1, [-1e30, 0.0])]), F.col("vec_id") == 0, 5).collect()
    assert [tuple(r) for r in huge] == [(0, 1, 1, -(metric_search.LARGEST**2))]


def test_bounds_save_products_without_losing_rows():
    rng = np.random.default_rng(3)
    centers = rng.integers(-300, 300, (40, 6))
    x = np.repeat(centers, 50, 0) + rng.integers(-4, 5, (2000, 6))
    x = np.concatenate([x, x[:3]])
    space = Space(6, int((x**2).sum(1).max()))
    ids = [np.array([i]) for i in range(len(x))]
    tree = Tree.build(space, x, ids, np.zeros(len(x), int), x[0])
    assert np.all(np.diff(tree.starts) <= metric_search.PAGE) and sorted(map(tuple, tree.vectors)) == sorted(map(tuple, x))
    again = Tree.unpacked(space, tree.packed())
    q = x[::37]
    best, computed = search(space, again, q, np.full(len(q), -(1 << 62)), 10, x[0])
    products = q @ x.T
    for i in range(len(q)):
        own = best.query == i
        want = sorted((-s, j) for j, s in enumerate(products[i]))[:10]
        assert sorted(zip((-best.score[own]).tolist(), best.id[own].tolist(), strict=True)) == want
    assert computed < len(q) * len(x) / 4


def test_large_components_stay_exact():
    big = 1 << 27
    x = np.array([[big, 1], [big, 2], [big, 3], [-big, 5]] * 40)
    space = Space(2, int((x**2).sum(1).max()))
    tree = Tree.build(space, x, [np.array([i]) for i in range(len(x))], np.zeros(len(x), int), x[0])
    best, _ = search(space, tree, x[:1], np.full(1, -(1 << 62)), 5, x[0])
    assert best.score.tolist() == [big * big + 3] * 5 and best.id.tolist() == [2, 6, 10, 14, 18]
