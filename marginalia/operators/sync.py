"""Keeping an index in step with its notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_text(path: Column, gist: Column, source: str = "gist") -> Column:
    """What is embedded: the gist if there is one and it is wanted, else the file name as words."""
    from ..functions.text import filename_text

    return F.coalesce(gist, filename_text(path)) if source == "gist" else filename_text(path)


def diff(files: DataFrame, stored: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, action): added, updated, unchanged or removed. ``files`` and ``stored`` have key, mtime and text; a change of
    either counts. One full outer join on the key."""
    f = files.select(key, F.col("mtime").alias("fm"), F.col(text).alias("ft"), F.lit(True).alias("f"))
    s = stored.select(key, F.col("mtime").alias("sm"), F.col(text).alias("st"), F.lit(True).alias("s"))
    same = F.col("fm").eqNullSafe(F.col("sm")) & F.col("ft").eqNullSafe(F.col("st"))
    action = F.when(F.col("s").isNull(), "added").when(F.col("f").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return f.join(s, key, "full_outer").select(key, action.alias("action"))


def sync_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("action").agg(F.count("*").alias("n"))


def apply(stored: DataFrame, files: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """The stored rows after the changes: added and updated ones from ``files``, removed ones gone."""
    new = files.join(changes.filter("action in ('added', 'updated')").select(key), key, "left_semi")
    old = stored.join(changes.filter("action = 'unchanged'").select(key), key, "left_semi")
    return old.select(*stored.columns).unionByName(new.select(*stored.columns))


def index_stats(notes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(notes, last_indexed, vectors), one row."""
    return notes.agg(F.count("*").alias("notes"), F.max("mtime").alias("last_indexed")).crossJoin(vectors.agg(F.count("*").alias("vectors")))  # one row by one row


def set_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    """The table (key, value) with a value set."""
    return meta.filter(F.col("key") != key).unionByName(meta.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def get_meta(meta: DataFrame, key: str) -> str | None:
    row = meta.filter(F.col("key") == key).first()
    return row["value"] if row else None


def clear_on_dimension_change(meta: DataFrame, vectors: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(meta, vectors) for vectors of a dimension: those of another one go."""
    old = get_meta(meta, "dimension")
    return set_meta(meta, "dimension", str(dimension)), vectors.limit(0) if old not in (None, str(dimension)) else vectors


def needs_rebuild(stored: DataFrame, vectors: DataFrame) -> bool:
    """Whether all must be embedded anew: there are notes but no vectors."""
    return not stored.isEmpty() and vectors.isEmpty()
