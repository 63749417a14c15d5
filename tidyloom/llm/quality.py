"""Quality of documents by ordinal regression on graded ratings.

A cumulative-link model shares one set of weights over hashed text between all grades and
sets them apart by ordered thresholds: P(grade >= k) = sigmoid(score - threshold k). It
gives the expected grade and, for selection, the probability of a grade or better.

The model is fitted on a sample of at most ROWS labelled documents, chosen by a hash of
their ids; every document is scored on its whole text.

Defined cases: labels without a grade or an id are left out, repeated labels count once;
without labels, or with one grade only, every document gets that grade (the lowest where
there is none) with certainty, and nothing is rejected; null texts are scored as empty.
Columns of the input with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.llm import features

#: Labelled documents that the model is fitted on, at most.
ROWS = 6000
#: Features that it may use.
FEATURES = 200
DAMP = 1e-3
STEPS = 300
PENALTY = 1e-4


def graded() -> Column:
    """Ratings of the labels: 0 poor, 1 well made but offensive, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)


class Ordinal:
    """Weights over all features and the ordered thresholds between grades."""

    def __init__(self, grades: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def tails(self, texts: list[bytes | None]) -> np.ndarray:
        """(texts, grades - 1) probabilities of each grade above the lowest, or better."""
        return features.sigmoid(features.scores(texts, self.weights[:, None]) - self.thresholds)


def thresholds_of(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free parameters: a first one and the logarithms of the steps."""
    return np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))


def fit(matrix: np.ndarray, grade: np.ndarray, grades: int, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model with the logistic link."""
    rows, columns = matrix.shape

    def gradient(x: np.ndarray) -> np.ndarray:
        w, raw = x[:columns], x[columns:]
        cut = np.concatenate(([-np.inf], thresholds_of(raw), [np.inf]))
        score = (matrix @ w.astype(np.float32)).astype(float)
        # Probability of reaching the own grade, and of reaching the next one.
        own = np.where(grade == 0, 1.0, features.sigmoid(score - np.where(grade == 0, 0, cut[grade])))
        next_ = np.where(grade == grades - 1, 0.0, features.sigmoid(score - np.where(grade == grades - 1, 0, cut[grade + 1])))
        mass = np.maximum(own - next_, 1e-12)
        by_score = -(1 - own - next_) / rows
        lower, upper = own * (1 - own) / mass / rows, -next_ * (1 - next_) / mass / rows
        by_cut = np.bincount(grade, lower, minlength=grades)[1:] + np.bincount(grade + 1, upper, minlength=grades + 1)[1:grades]
        by_raw = np.array([by_cut[i:].sum() * (np.exp(raw[i]) if i else 1) for i in range(len(raw))])
        return np.concatenate((matrix.T @ by_score.astype(np.float32) + penalty * w, by_raw))

    share = np.cumsum(np.bincount(grade, minlength=grades))[:-1] / rows
    cut = np.log(share / (1 - share))
    start = np.concatenate((np.zeros(columns), cut[:1], np.log(np.diff(cut))))
    x = features.descend(gradient, start, steps)
    return x[:columns], thresholds_of(x[columns:])


def train(docs: DataFrame, labels: DataFrame, grade: Column | None = None, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> Ordinal:
    """Fit the model on labelled documents; ``grade`` is computed from the labels."""
    graded_ = labels.select(F.col(key), (graded() if grade is None else grade).cast("int").alias("grade")).where("grade IS NOT NULL")
    marks, row, at, value = features.sample(docs, graded_, key, text, rows, ["grade"])
    grades, own = np.unique(np.array([m[0] for m in marks], int), return_inverse=True)
    if len(grades) < 2:
        return Ordinal(grades, np.zeros(features.SIZE), np.zeros(0))
    # The lowest step decides about selection, so features are chosen by it.
    chosen = features.Selected(len(marks), row, at, value, (own > 0).astype(float), FEATURES, DAMP)
    weights, thresholds = fit(chosen.matrix, own, len(grades))
    return Ordinal(grades, chosen.weights(weights), thresholds)


def score(docs: DataFrame, model: Ordinal, least: int, text: str = "text", at_least: float = 0.4) -> DataFrame:
    """All columns, with expected_grade, p_keep (a grade of ``least`` or better) and keep."""
    names = ("expected_grade", "p_keep", "keep")
    schema = T.StructType([f for f in docs.schema.fields if f.name not in names] + [
        T.StructField("expected_grade", T.DoubleType()), T.StructField("p_keep", T.DoubleType()), T.StructField("keep", T.BooleanType())
    ])
    kept = [f.name for f in schema.fields[:-3]]
    grades = model.grades.astype(float) if len(model.grades) else np.zeros(1)
    tail = int(np.searchsorted(grades[1:], least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.tails(batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist())
            expected = grades[0] + tails @ np.diff(grades)
            chance = tails[:, tail] if tail < tails.shape[1] else np.ones(len(tails))
            columns = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(expected), pa.array(chance), pa.array(chance >= at_least)], [*kept, *names])

    return docs.mapInArrow(run, schema)
