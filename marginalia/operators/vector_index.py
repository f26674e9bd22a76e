"""Inverted lists of vectors on disk, with insertions, deletions and lists that are split when they outgrow a bound.

Vectors are filed by list, so that a search reads the lists it looks into and no others. What is inserted later is a segment
of its own under the same lists; what is deleted or replaced is named in a table. As in ``segments``, a segment counts once the
last of its tables is written, and one that was left half-way is replaced under its number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ann import RECALL, Index, assign, calibrate, centroids, fit, ids_and_vectors
from .knn import unit
from .segments import read_table

VECTORS = "id bigint, vec array<double>, segment int, list int"
DEAD = "id bigint, of int, segment int"
CENTROIDS = "list int, vec array<double>, segment int"
STATE = "base boolean, centroids int, probes int, segment int"
#: Vectors of a list that a split is fitted on at most, and lists that are split at once at most.
SAMPLE, SPLITS = 2000, 256


class VectorIndex:
    """The index in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _state(self) -> list:
        """(segment, base, centroids, probes) of the segments that count, from the last base on."""
        rows = sorted(read_table(self.spark, f"{self.folder}/state", STATE).select("segment", "base", "centroids", "probes").collect())  # a row a segment
        start = max((i for i, r in enumerate(rows) if r["base"]), default=0)
        return rows[start:]

    def _of(self, name: str, schema: str, segments: list[int]) -> DataFrame:
        rows = read_table(self.spark, f"{self.folder}/{name}", schema)
        return rows.filter(F.col("segment").isin(*segments) if segments else F.lit(False))

    def rows(self) -> DataFrame:
        """(list, id, vec, segment) of the vectors that are in the index."""
        segments = [r["segment"] for r in self._state()]
        held = self._of("vectors", VECTORS, segments)
        if len(segments) < 2:
            return held
        dead = self._of("dead", DEAD, segments[1:]).select("id", F.col("of").alias("segment"))
        return held.join(dead, ["id", "segment"], "left_anti")

    def centroids(self) -> np.ndarray:
        state = self._state()
        if not state:
            return np.zeros((0, 1))
        held = self._of("centroids", CENTROIDS, [state[-1]["centroids"]]).orderBy("list").toArrow()
        return np.array(held["vec"].to_pylist(), float) if held.num_rows else np.zeros((0, 1))

    def open(self) -> Index:
        """The index as it is now, for searching."""
        state, fitted = self._state(), self.centroids()
        return Index(self.rows(), fitted, min(state[-1]["probes"], max(1, len(fitted))) if state else 1)

    def search(self, queries: DataFrame, k: int, key: str, vec: str, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): about the ``k`` nearest other rows of each query, each with its exact score."""
        return self.open().search(queries, k, key, vec, probes)

    def sizes(self) -> DataFrame:
        """(list, n): the vectors of each list."""
        return self.rows().groupBy("list").agg(F.count("*").alias("n"))

    def _write(self, rows: DataFrame, name: str, segment: int, *by: str) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{name}/segment={segment}")

    def _filed(self, rows: DataFrame, segment: int) -> None:
        self._write(rows.select("id", "vec", "list").repartition("list", F.pmod(F.xxhash64("id"), F.lit(4))), "vectors", segment, "list")

    def _centres(self, fitted: np.ndarray, segment: int) -> None:
        self._write(self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fitted)], "list int, vec array<double>").coalesce(1), "centroids", segment)

    def _commit(self, segment: int, base: bool, centres: int, probes: int) -> int:
        self._write(self.spark.createDataFrame([(base, centres, probes)], "base boolean, centroids int, probes int").coalesce(1), "state", segment)
        return segment

    def write(self, df: DataFrame, key: str, vec: str, k: int = 10, wanted: float = RECALL) -> int:
        """Replaces the index by one of all rows of ``df`` with a key and a vector, of which each key has one, that which is first
        by value. Centroids are fitted on a bounded sample; the number of lists to look into is measured."""
        state = self._state()
        segment = (state[-1]["segment"] if state else -1) + 1
        rows = ids_and_vectors(df, key, vec).groupBy("id").agg(F.min("vec").alias("vec"))
        fitted = fit(rows)
        self._centres(fitted, segment)
        self._filed(assign(rows, fitted) if len(fitted) else rows.withColumn("list", F.lit(0)), segment)
        written = read_table(self.spark, f"{self.folder}/vectors", VECTORS).filter(F.col("segment") == segment)
        return self._commit(segment, True, segment, calibrate(Index(written, fitted, 1), written.select("id", "vec"), k, wanted))

    def _bury(self, ids: DataFrame, segment: int) -> None:
        self._write(self.rows().filter(F.col("segment") < segment).join(ids, "id", "left_semi").select("id", F.col("segment").alias("of")), "dead", segment)

    def insert(self, df: DataFrame, key: str, vec: str, segment: int | None = None) -> int:
        """Adds vectors to the lists of their centroids, in place of those of the same key."""
        state = self._state()
        if not state or not len(self.centroids()):
            return self.write(df, key, vec)
        segment = segment if segment is not None else state[-1]["segment"] + 1
        rows = ids_and_vectors(df, key, vec).groupBy("id").agg(F.min("vec").alias("vec"))
        self._filed(assign(rows, self.centroids()), segment)
        self._bury(rows.select("id"), segment)
        return self._commit(segment, False, state[-1]["centroids"], state[-1]["probes"])

    def delete(self, ids: DataFrame, segment: int | None = None) -> int:
        """Removes the vectors with these ids (a column ``id``)."""
        state = self._state()
        segment = segment if segment is not None else (state[-1]["segment"] if state else -1) + 1
        self._bury(ids.select(F.col("id").cast("long")), segment)
        return self._commit(segment, not state, state[-1]["centroids"] if state else segment, state[-1]["probes"] if state else 1)

    def split(self, most: int, k: int = 10, wanted: float = RECALL) -> int:
        """Splits the lists of more than ``most`` vectors into as many as keep to that on average, and gives how many there were.
        Their vectors are filed again; the number of lists to look into is measured anew. Other lists stay as they are."""
        large = [(r["list"], r["n"]) for r in self.sizes().filter(F.col("n") > most).orderBy(F.desc("n"), "list").limit(SPLITS).collect()]
        if not large:
            return 0
        state, fitted = self._state(), self.centroids()
        segment, moved = state[-1]["segment"] + 1, self.rows().filter(F.col("list").isin(*[c for c, _ in large]))
        nth = F.row_number().over(W.partitionBy("list").orderBy("h", "id"))
        # of each list the rows with the least hashes: a share first, so that a window sorts some of a list's rows only
        share = moved.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).join(F.broadcast(self.spark.createDataFrame([(c, int(min(1.0, 2.0 * SAMPLE / n) * (1 << 30))) for c, n in large], "list int, below bigint")), "list").filter("h < below")
        sample = share.withColumn("nth", nth).filter(F.col("nth") <= SAMPLE).select("list", "vec").toArrow()
        of, x = np.asarray(sample["list"]), np.array(sample["vec"].to_pylist(), float)
        centres = list(fitted)
        for c, n in large:
            found = centroids(unit(x[of == c]), -(-n // most) + 1)
            centres[c] = found[0]
            centres += list(found[1:])
        centres = np.array(centres)
        self._centres(centres, segment)
        self._filed(assign(moved.select("id", "vec"), centres), segment)
        self._write(moved.select("id", F.col("segment").alias("of")), "dead", segment)
        self._commit(segment, False, segment, len(centres))
        index = self.open()
        self._commit(segment, False, segment, calibrate(index, self.rows().select("id", "vec"), k, wanted))
        return len(large)

    def compact(self) -> int:
        """Writes one base segment of what is in the index, under the lists it is in."""
        state, segment = self._state(), self._state()[-1]["segment"] + 1
        self._centres(self.centroids(), segment)
        self._filed(self.rows(), segment)
        return self._commit(segment, True, segment, state[-1]["probes"])
