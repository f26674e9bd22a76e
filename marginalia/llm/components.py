"""Connected components by alternating large-star and small-star steps, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Work, join_hot


def _with_least(edges: DataFrame, ends: int) -> DataFrame:
    """``edges`` (a, b) with m, the least b of each a. A node with many edges is joined where its edges are."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return join_hot(edges, least, "a", "n", ends)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * n).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) all have a > b. The edge from a to its least b comes out of b's own row, which others repeat."""
    return _with_least(edges, n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _written(work: Work, edges: DataFrame) -> tuple[DataFrame, int, tuple]:
    """Distinct edges between different nodes as a table, their number, and a sign that tells them from others."""
    table = work.cut(edges.filter("a <> b").distinct(), "edges")
    sign = table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first()
    return table, sign[0], tuple(sign)


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b); the label is the smallest node reachable.

    Each step is a written table; no links reach the driver. Nulls must not occur.
    """
    now, n, seen = _written(work, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        larger, n, _ = _written(work, _large_star(now, n))
        after, n, sign = _written(work, _small_star(larger, n))
        work.drop(now, larger)
        now = after
        if sign == seen:
            labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
            labels._work_path = now._work_path
            return labels
        seen = sign
