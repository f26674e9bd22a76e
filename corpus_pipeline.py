"""The corpus pipeline: documents in, sharded training documents out. Part of the subpackage llm."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.classifier import classify_quality
from marginalia.llm.decontaminate import decontaminate
from marginalia.llm.mix import mix
from marginalia.llm.near_dedup import LINK, near_duplicates
from marginalia.llm.shard import place
from marginalia.llm.storage import Work

#: Hundredths of Jaccard similarity from which the pipeline's near-dedup stage links documents; op1 has its own threshold.
SIMILARITY = 80


def _key(docs: DataFrame) -> Column:
    """The doc_id or, of a row without one, a number from 2^62 up, by its text. The stages decide on keys, so that rows
    without an id are judged each by its text, and rows that share an id together."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62)))


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, row) of ``docs``: a row is one struct, so that columns of any name keep their values."""
    return docs.select(_key(docs).alias("key"), F.struct(*docs.columns).alias("row"))


def _rows(keyed: DataFrame) -> DataFrame:
    return keyed.select("row.*")


def _by_key(docs: DataFrame) -> DataFrame:
    return docs.select(_key(docs).alias("doc_id"), "text", "source")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``dropped`` (doc_id)."""
    return _rows(_keyed(docs).join(dropped.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text has a score like others and goes or stays by it; a row without a doc_id goes by its text; of
    rows that share a doc_id all go if one is rejected. An empty table stays empty, other columns stay as they are.
    """
    scored = classify_quality(_by_key(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.filter("predicted = 0"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: int = LINK) -> DataFrame:
    """One document of each group of near duplicates (linked from ``similarity`` hundredths up) stays, that with the smallest
    doc_id, and one row of it.

    Null, empty and white texts are linked with nothing and stay, though repeated rows of one become one. Of rows that
    share a doc_id the first by all columns stays. Rows without a doc_id are one document a text. An empty table stays
    empty, other columns stay as they are.
    """
    marked = Work(spark, "near").cut(near_duplicates(_by_key(docs), similarity=similarity).groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")), "marked")
    kept = _without(docs, marked.filter(~F.col("kept")))
    again = marked.filter("kept and n > 1").select(F.col("doc_id").alias("key"))
    if again.isEmpty():
        return kept
    keyed = _keyed(kept)
    once = keyed.join(again, "key", "left_semi").groupBy("key").agg(F.min(F.struct(F.to_json("row").alias("order"), "row")).alias("first"))
    return _rows(keyed.join(again, "key", "left_anti")).unionByName(once.select("first.row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents a twentieth of whose words lie in benchmark windows go.

    Null, empty and wordless texts have no words and stay. A row without a doc_id goes by its text; of rows that share a
    doc_id all go if one is contaminated. An empty table, or benchmark, leaves all as it is; other columns stay too.
    """
    return _without(docs, decontaminate(_by_key(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document. The part of a document at a source's cut counts as a whole one if
    it is at least half of it; documents that the mix doesn't take go.

    Null, empty and white texts have no words: none of them is taken, and they go. Rows that share a doc_id go by their
    sum, rows without one by their text. A null source is a source. An empty table stays empty; other columns stay.
    """
    taken = mix(_by_key(docs)).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    copies = _keyed(docs).join(taken.select(F.col("doc_id").alias("key"), times.alias("times")).filter("times > 0"), "key")
    return _rows(copies.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their slot and shard, which replace columns of these names.

    A row's key is its doc_id, else its text, null like empty; rows with one key share a shard. An empty table stays empty.
    """
    return place(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near-dedup", partial(near_dedup, similarity=SIMILARITY)),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: Stages 1 and 2 train a classifier and compare sketches; SQL doesn't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each reads what the one before has written."""
    work, docs = Work(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
