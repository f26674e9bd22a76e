"""Labelled rows for classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; null for a row without one."""
    return F.crc32(doc_id.cast("string")) % of


def binary_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) with label 0 or 1, one row a document: other values and rows without a doc_id are left out, and
    of contradicting rows the lower label counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return known.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))


def sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled rows, those whose doc_id has the least hashes: alike for every run, as rows that share an
    id come in the order of their other columns."""
    return labels.orderBy(F.xxhash64("doc_id"), *labels.columns).limit(most)
