"""Quality classifier: regularised quadratic discriminant analysis on transformed document statistics.

One pass turns every text into its statistics, a small row that is written. Sums and products of the statistics of all
labelled training rows give the class means and covariances, by one grouped aggregation. Covariances are shrunk towards
the pooled one and a little towards its diagonal, and each is used through its Cholesky factor, computed once. A score
is the sigmoid of the difference of the two Mahalanobis log densities, calibrated on at most ``SAMPLE`` training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .doc_stats import STATISTICS, counted, statistics
from .kernels import list_values, lists
from .labels import binary_labels, fold, sample
from .quality_rules import platt, sigmoid
from .storage import Work

FOLDS, THRESHOLD = 5, 0.3
POOLED, DIAGONAL, SAMPLE = 0.2, 0.02, 20_000


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(c) for c in counted(batch.column(1))]
        flat = np.concatenate(x) if x else np.zeros((0, len(STATISTICS)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(flat.ravel(), [len(STATISTICS)] * len(flat))], ["doc_id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and class: the place and the value of each sum of 1, x and x*x'."""
    for batch in batches:
        x = list_values(batch.column(1))[0].reshape(-1, len(STATISTICS))
        y = np.asarray(batch.column(0))
        for label in np.unique(y):
            z = np.column_stack([np.ones((y == label).sum()), x[y == label]])
            sums = (z.T @ z).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), label, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["label", "place", "value"])


class Discriminant:
    """The two class densities, each by its mean, the inverse of its Cholesky factor, and its log determinant and prior."""

    def __init__(self, sums: dict[int, np.ndarray]):
        d = len(STATISTICS)
        self.a, self.b, self.classes = 1.0, 0.0, {}
        total = sum(s[0, 0] for s in sums.values())
        pooled = sum(s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) / s[0, 0] for s in sums.values()) / max(total, 1) if sums else np.eye(d)
        for label, s in sums.items():
            n, mean = s[0, 0], s[0, 1:] / s[0, 0]
            own = s[1:, 1:] / n - np.outer(mean, mean)
            weight = n / (n + 10 * d)  # few rows lean on the pooled covariance
            cov = weight * (1 - POOLED) * own + (1 - weight * (1 - POOLED)) * pooled
            cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.classes[label] = (mean, np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log(n / total))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 less that of label 0, priors included; with one class, that class."""
        if len(self.classes) < 2:
            return np.full(len(x), {(): 0.0, (1,): 4.0, (0,): -4.0}[tuple(self.classes)])
        logs = {}
        for label, (mean, inverse, constant) in self.classes.items():
            z = (x - mean) @ inverse.T
            logs[label] = constant - 0.5 * (z * z).sum(axis=1)
        # a long tail must not decide alone: the difference grows with its logarithm beyond the dimension
        d = logs[1] - logs[0]
        return np.sign(d) * len(STATISTICS) * np.log1p(np.abs(d) / len(STATISTICS))

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.difference(x) + self.b)


def train(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """``stats`` (doc_id, x) of all documents, ``labels`` (doc_id, label) of the training rows, one a document."""
    rows = stats.join(labels, "doc_id").select("label", "x", "doc_id")
    sums = rows.select("label", "x").mapInArrow(_moments, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).toArrow()
    label, place, value = (np.asarray(sums[c]) for c in ("label", "place", "value"))
    d = len(STATISTICS) + 1
    by_class = {}
    for k in np.unique(label):
        s = np.zeros(d * d)
        s[place[label == k]] = value[label == k]
        by_class[int(k)] = s.reshape(d, d)
    model = Discriminant(by_class)
    if len(by_class) == 2:
        chosen = sample(rows, SAMPLE).select("label", "x").toArrow()
        x = list_values(chosen["x"])[0].reshape(-1, len(STATISTICS))
        a, b = platt(model.difference(x), np.asarray(chosen["label"]))
        model.a, model.b = max(a, 1e-3), b
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = list_values(batch.column(1))[0].reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    return run


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text); only the text is an input of a score.

    Labels of rows with crc32(doc_id) mod 5 = 0 are held out. Null and empty texts have statistics too and get a score.
    A row without a doc_id is not held out and has no label. Rows that share a doc_id are scored each by its text.
    Without labels of both classes each text scores alike. A very long text has statistics of the whole. An empty table
    gives an empty result. Columns other than doc_id, text and quality are ignored.
    """
    work = Work(docs.sparkSession, "classifier")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = work.cut(docs.mapInArrow(_statistics, "doc_id bigint, x array<double>"), "statistics")
    model = train(stats, binary_labels(labels, "quality").filter(fold(F.col("doc_id"), FOLDS) != 0))
    scored = stats.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id bigint, score double")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
