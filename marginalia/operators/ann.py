"""Approximate nearest neighbours with inverted lists: vectors are filed under the nearest of some centroids, and a query
looks into the lists of the centroids nearest to it. How many is measured, so that enough of the true neighbours are found."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import FOUND, Best, blocks, knn_join, pieces, ranked, unit, vectors_of

#: Centroids at most, rows they are fitted on at most, rounds of that, and queries that the number of lists is measured on.
MOST, SAMPLE, ROUNDS, TRIALS = 1024, 20_000, 8, 64
RECALL = 0.95


def centroids(sample: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """``n`` unit vectors that stand for a sample of unit vectors: spherical k-means."""
    rng = np.random.default_rng(seed)
    out = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = (sample @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, nearest, sample)
        met = np.bincount(nearest, minlength=len(out)) > 0
        out[met] = unit(sums[met])
    return out


@dataclass
class Index:
    """Vectors by list (list, id, vec), best written partitioned or sorted by list; the centroids; how many lists to look into."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int

    def search(self, queries: DataFrame, k: int, key: str, vec: str, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): about the ``k`` nearest other rows of each query, each with its exact score."""
        passes = [self._pass(ids, q, k, probes or self.probes) for ids, q in blocks(queries, key, vec)] if len(self.centroids) else []
        return ranked(passes, k, self.rows)

    def _pass(self, ids: np.ndarray, q: np.ndarray, k: int, probes: int) -> DataFrame:
        lists = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]
        wanted = {int(c): np.flatnonzero((lists == c).any(axis=1)) for c in np.unique(lists)}
        sent = self.rows.sparkSession.sparkContext.broadcast((ids, q, wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, wanted = sent.value
            best, none = Best(ids, q, k), np.zeros(0, np.int64)
            for batch in pieces(batches):
                held = np.asarray(batch.column(0))
                for c in np.unique(held):
                    if len(asked := wanted.get(int(c), none)):
                        best.add(*vectors_of(batch.filter(pa.array(held == c)), 1, 2, q.shape[1]), asked)
            yield best.batch()

        rows = self.rows if len(wanted) == len(self.centroids) else self.rows.filter(F.col("list").isin(*sorted(wanted)))
        return rows.select("list", "id", "vec").mapInArrow(run, FOUND)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query_id, id) that were found."""
    total = exact.count()
    return found.join(exact, ["query_id", "id"], "left_semi").count() / total if total else 1.0


def fit(rows: DataFrame, most: int = MOST) -> np.ndarray:
    """Centroids of rows (id, vec), about the square root of their number, fitted on at most SAMPLE rows, those with the least
    hashes of their ids."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    held = unit(np.array(sample["vec"].to_pylist(), float)) if sample.num_rows else np.zeros((0, 1))
    return centroids(held, min(most, max(1, int(rows.count() ** 0.5)))) if len(held) else held


def assign(rows: DataFrame, fitted: np.ndarray) -> DataFrame:
    """(list, id, vec) of rows (id, vec): the nearest centroid, and the vector at length one."""
    sent = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, x = vectors_of(batch, 0, 1, sent.value.shape[1])
            kept = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array((x @ sent.value.T).argmax(axis=1).astype(np.int32) if len(ids) else [], pa.int32()), pa.array(ids, pa.int64()), kept], ["list", "id", "vec"])

    return rows.mapInArrow(run, "list int, id bigint, vec array<double>")


def ids_and_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter("id is not null and vec is not null")


def calibrate(index: Index, rows: DataFrame, k: int, wanted: float = RECALL) -> int:
    """The number of lists to look into, the least, doubling, with which the ``k`` nearest of TRIALS rows are found to the share
    ``wanted``, against ``knn_join``; with all lists the search is exact."""
    trials = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIALS)
    exact, probes, n = knn_join(rows, trials, k, "id", "vec").select("query_id", "id").persist(), 1, len(index.centroids)
    while probes < n and recall(index.search(trials, k, "id", "vec", probes), exact) < wanted:
        probes *= 2
    exact.unpersist()
    return min(probes, max(n, 1))


def build(df: DataFrame, key: str, vec: str, k: int = 10, wanted: float = RECALL) -> Index:
    """An index of all rows of ``df`` with a vector, which each search reads and assigns anew; ``VectorIndex`` is one on disk."""
    rows = ids_and_vectors(df, key, vec)
    fitted = fit(rows)
    index = Index(assign(rows, fitted), fitted, max(len(fitted), 1))
    index.probes = calibrate(index, rows, k, wanted)
    return index
