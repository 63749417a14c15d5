"""Toxicity by a classifier chain over hashed text.

Categories are predicted one after the other by linear models; each model also sees the
probabilities of the categories before it. In training those are out-of-fold predictions,
so that a later model meets the same kind of errors as in use.

The models are fitted on a sample of at most ROWS labelled documents, chosen by a hash of
their ids; every document is scored on its whole text.

Defined cases: labels with a null category or id are left out, repeated labels count once;
a category without both outcomes in the sample gets its share as a constant; without
labels all probabilities are 0; null texts are scored as empty. Columns of the input with
the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.llm import features

#: Labelled documents that the models are fitted on, at most.
ROWS = 6000
#: Features that a model may use.
FEATURES = 800
DAMP = 1e-4
FOLDS = 5
STEPS = 200
PENALTY = 1e-4

#: Categories in the order of the chain, from the labels.
CATEGORIES: dict[str, str] = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def logistic(matrix: np.ndarray, mark: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Weights and, last, the intercept."""
    rows, columns = matrix.shape

    def gradient(x: np.ndarray) -> np.ndarray:
        error = (features.sigmoid((matrix @ x[:columns].astype(np.float32)).astype(float) + x[columns]) - mark) / rows
        return np.concatenate((matrix.T @ error.astype(np.float32) + penalty * x[:columns], [error.sum()]))

    share = np.clip(mark.mean(), 1e-6, 1 - 1e-6)
    return features.descend(gradient, np.concatenate((np.zeros(columns), [np.log(share / (1 - share))])), steps)


class Chain:
    """Per category: weights over the text, over the categories before, and an intercept."""

    def __init__(self, names: list[str], weights: np.ndarray, before: list[np.ndarray], intercepts: list[float]):
        self.names, self.weights, self.before, self.intercepts = names, weights, before, intercepts

    def predict(self, texts: list[bytes | None]) -> np.ndarray:
        """(texts, categories) probabilities."""
        own = features.scores(texts, self.weights)
        out = np.zeros_like(own)
        for c in range(len(self.names)):
            out[:, c] = features.sigmoid(own[:, c] + out[:, :c] @ self.before[c] + self.intercepts[c])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> Chain:
    """Fit the chain; ``categories`` maps names to SQL conditions over the labels."""
    categories = CATEGORIES if categories is None else categories
    names = list(categories)
    conditions: list[Column] = [F.expr(c).cast("int").alias(f"__c{i}") for i, c in enumerate(categories.values())]
    marked = labels.select(F.col(key), *conditions).dropna()
    marks, row, at, value = features.sample(docs, marked, key, text, rows, [f"__c{i}" for i in range(len(names))])
    n = len(marks)
    known = np.array(marks, float).reshape(n, len(names))
    fold = np.arange(n) % FOLDS
    weights, before, intercepts = np.zeros((features.SIZE, len(names))), [], []
    earlier = np.zeros((n, 0))
    for c in range(len(names)):
        mark = known[:, c]
        if not 0 < mark.sum() < n:
            before.append(np.zeros(c))
            intercepts.append(50.0 if n and mark.all() else -50.0)
            earlier = np.column_stack((earlier, mark))
            continue
        chosen = features.Selected(n, row, at, value, mark, FEATURES, DAMP)
        matrix = np.column_stack((chosen.matrix, earlier.astype(np.float32)))
        fitted = logistic(matrix, mark)
        columns = len(chosen.index)
        weights[:, c] = chosen.weights(fitted[:columns])
        before.append(fitted[columns:-1])
        intercepts.append(float(fitted[-1]))
        out_of_fold = np.zeros(n)
        for f in range(FOLDS) if c + 1 < len(names) else ():
            inside = fold != f
            # Marks of held-out rows are hidden from the choice of features.
            part = features.Selected(n, *_rows(row, at, value, inside), np.where(inside, mark, mark[inside].mean()), FEATURES, DAMP)
            x = logistic(np.column_stack((part.matrix, earlier.astype(np.float32)))[inside], mark[inside])
            text_score = np.bincount(row, value * part.weights(x[: len(part.index)])[at], minlength=n)
            out_of_fold[~inside] = features.sigmoid(text_score + earlier @ x[len(part.index) : -1] + x[-1])[~inside]
        earlier = np.column_stack((earlier, out_of_fold))
    return Chain(names, weights, before, intercepts)


def _rows(row: np.ndarray, at: np.ndarray, value: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = inside[row]
    return row[own], at[own], value[own]


def score(docs: DataFrame, chain: Chain, text: str = "text", at_least: float = 0.4) -> DataFrame:
    """All columns, with the probability p_<category> of each, and whether it is ``at_least``."""
    made = [f"p_{n}" for n in chain.names] + [f"is_{n}" for n in chain.names]
    kinds = [T.DoubleType()] * len(chain.names) + [T.BooleanType()] * len(chain.names)
    schema = T.StructType([f for f in docs.schema.fields if f.name not in made] + [T.StructField(n, k) for n, k in zip(made, kinds, strict=True)])
    kept = [f.name for f in schema.fields if f.name not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = chain.predict(batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist())
            columns = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            columns += [pa.array(c) for c in chance.T] + [pa.array(c >= at_least) for c in chance.T]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

    return docs.mapInArrow(run, schema)
