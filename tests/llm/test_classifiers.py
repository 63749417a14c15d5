"""Classifiers: slopes against differences, held-out labels, tables with gaps."""

import numpy as np
import pytest

from pyspark.sql import functions as F
from tests.llm import odd
from tidyloom.llm import features, quality, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    return tuple(spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))


def test_scores_are_weighted_densities():
    texts = [t.encode() if t is not None else None for _, t, _ in odd.texts()]
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(features.SIZE, 2))
    want = np.array([value @ weights[at] for at, value in features.vectors(texts)])
    assert np.allclose(features.scores(texts, weights), want)
    assert features.scores([], weights).shape == (0, 2)


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3)).astype(np.float32)
    score = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=3000)
    grade = np.digitize(score, [-1.0, 1.5])
    w, cut = quality.fit(x, grade, 3, penalty=0, steps=600)
    assert np.allclose(w, [2, -1, 0], atol=0.3) and np.allclose(cut, [-1, 1.5], atol=0.3)


def test_thresholds_stay_in_order():
    assert (np.diff(quality.thresholds_of(np.array([3.0, -20.0, 2.0, 0.0]))) > 0).all()


def test_quality_on_held_out_labels(data):
    docs, labels = data
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality.score(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), model, 1).select("quality", "keep", "p_keep", "expected_grade").collect()
    poor, good = ([r.keep for r in rows if r.quality == q] for q in (0, 1))
    assert sum(poor) <= 0.2 * len(poor) and sum(good) >= 0.98 * len(good)
    assert all(0 <= r.p_keep <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_toxicity_on_held_out_labels(data):
    docs, labels = data
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    assert len(chain.before[1]) == 1
    rows = toxicity.score(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), chain).select("toxic", "is_toxic").collect()
    toxic, clean = ([r.is_toxic for r in rows if r.toxic == t] for t in (1, 0))
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_later_models_see_earlier_probabilities(data):
    """A second category that repeats the first is carried by the chain."""
    docs, labels = data
    chain = toxicity.train(docs, labels, {"first": "toxic = 1", "again": "toxic = 1"})
    assert chain.before[1][0] > 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_gaps(spark, data, module):
    docs, labels = odd.table(spark), data[1]
    score = (lambda d, m: quality.score(d, m, 1)) if module is quality else toxicity.score
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (1, None, 0), (2, 1, None)], labels.schema)
    for marks in (labels.limit(0), nulls, spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 1, 0)], labels.schema)):
        rows = score(docs, module.train(docs, marks)).collect()
        assert len(rows) == len(odd.texts())
        assert all(r.keep if module is quality else not r.is_toxic for r in rows)
    model = module.train(docs, labels)
    first = odd.counted(score(docs, model).drop("n_chars").collect())
    assert first == odd.counted(score(docs, module.train(docs, labels)).drop("n_chars").collect())
    assert score(docs.limit(0), model).count() == 0


def test_sample_is_bounded(data):
    docs, labels = data
    marks, row, at, value = features.sample(docs, labels, "doc_id", "text", 50, ["quality"])
    assert len(marks) == 50 and row.max() == 49 and at.max() < features.SIZE and (value >= 0).all()
    assert docs.select(F.count("*")).first()[0] > 50


def test_sample_takes_a_repeated_key_once(spark):
    labels = spark.range(1, 11).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    single = spark.range(1, 11).selectExpr("id AS doc_id", "concat('a text of number ', id) AS text")
    copies = spark.range(400).selectExpr("3L AS doc_id", "if(id % 2 = 0, 'a text of number 3', concat('b other text ', id)) AS text")
    empty = spark.range(5).selectExpr("4L AS doc_id", "cast(NULL AS string) AS text")
    want = features.sample(single, labels, "doc_id", "text", 10, ["quality"])
    found = features.sample(single.union(copies).union(empty), labels, "doc_id", "text", 10, ["quality"])
    assert len(found[0]) == 10 and found[0] == want[0]
    assert all((a == b).all() for a, b in zip(found[1:], want[1:], strict=True))
    assert len(features.sample(single.union(copies), labels, "doc_id", "text", 4, ["quality"])[0]) == 4
