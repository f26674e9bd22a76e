"""Top hits out of an index in blocks: those of the whole scan, with fewer postings read."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from marginalia.operators import search
from marginalia.operators.block_max import BlockIndex


def notes(spark, n=3000):
    """Common words everywhere, rare ones in few notes of different lengths, ties, an empty and a null text."""
    rng, rows = random.Random(3), []
    for i in range(n):
        words = rng.choices(["the", "of", "note", "index", "term"], k=rng.randint(3, 60))
        words += ["rare"] * (1 + i % 3) if i % 97 == 0 else []
        words += ["seldom"] if i % 211 == 0 else []
        rows.append((f"n{i:05}.md", " ".join(words)))
    rows += [("tie-b.md", "rare seldom"), ("tie-a.md", "rare seldom"), ("empty.md", ""), ("null.md", None)]
    return spark.createDataFrame(rows, "path string, body string")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    df = notes(spark).persist()
    return df, BlockIndex.write(df, f"{tmp_path_factory.mktemp('b')}/{uuid.uuid4().hex}", columns={"body": F.col("body")}, block=16)


def rows(df):
    return [(r["path"], round(r["score"], 7)) for r in df.select("path", "score").collect()]


@pytest.mark.parametrize("query", ["rare seldom the", "seldom", "the of", "rare Rare +index -note", "absent rare"])
@pytest.mark.parametrize("limit", [1, 10, 60])
def test_hits_are_those_of_the_scan(made, query, limit):
    df, index = made
    words = " ".join(search.query_terms(query))
    assert rows(index.search(query, limit, boosts={"body": 1.0})) == rows(search.bm25(df, words, limit, boosts={"body": 1.0}, columns={"body": F.col("body")}))


def test_most_postings_are_not_read(made):
    _, index = made
    boosts = {"body": 1.0}
    held = index.blocks.filter(F.col("term").isin("rare", "seldom", "the")).agg(F.sum("df")).first()[0]
    read = index.candidates("rare seldom the", 10, boosts).agg(F.sum("df")).first()[0]
    assert held > 2500 and read < held / 5
    plan = index.search("rare seldom the", 10, boosts=boosts)._jdf.queryExecution().toString()
    assert "In(block" in plan and "In(term" in plan


def test_more_blocks_than_are_listed(made, monkeypatch):
    df, index = made
    listed = rows(index.search("the rare", 25, boosts={"body": 1.0}))
    monkeypatch.setattr("marginalia.operators.block_max.LISTED", 1)
    assert rows(index.search("the rare", 25, boosts={"body": 1.0})) == listed


def test_zones_fields_and_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("marginalia.operators.block_max.ZONE", 100)
    df = notes(spark, 700).withColumn("gist", F.when(F.col("path").endswith("7.md"), F.lit("rare gist"))).withColumn("tags", F.array(F.lit("term")))
    index = BlockIndex.write(df, f"{tmp_path}/a", block=4)
    assert index.blocks.select("zone").distinct().count() > 3 and index.notes == 704
    assert rows(index.search("rare term", 12)) == rows(search.bm25(df, "rare term", 12))
    assert sorted(rows(index.search("rare", None))) == sorted(rows(search.bm25(df, "rare", None)))
    assert rows(index.search("", 5)) == rows(index.search("nowhere", 5)) == rows(index.search("rare", 0)) == []
    empty = BlockIndex.write(df.limit(0), f"{tmp_path}/b")
    assert empty.notes == 0 and rows(empty.search("rare", 5)) == []


def test_serves_searches_as_an_index(made):
    df, index = made
    got = search.search(df.withColumn("gist", F.lit("x")).withColumn("vec", F.lit(None).cast("array<float>")), "seldom rare", 3, "keyword", key="path", index=index)
    assert [r["path"] for r in got.collect()] == []  # the index has no field that searches boost


def test_a_zone_is_what_one_task_can_read():
    from marginalia.operators import block_max

    assert block_max.ZONE <= 1 << 15  # whole texts of a zone's notes go through one task


def test_notes_stay_in_their_task(spark, tmp_path, monkeypatch):
    """A zone is cut out of the notes of one task, so nothing is shuffled, and has a bounded number of words."""
    monkeypatch.setattr("marginalia.operators.block_max.WORDS", 500)
    df = notes(spark, 600).repartition(3).persist()
    index = BlockIndex.write(df, f"{tmp_path}/a", columns={"body": F.col("body")}, block=4)
    zones = index.blocks.select("zone", F.explode("notes").alias("x")).join(df.withColumn("task", F.spark_partition_id()), F.col("x.key") == F.col("path"))
    found = zones.groupBy("zone").agg(F.count_distinct("task").alias("tasks"), F.sum("x.tf").alias("words")).collect()
    assert len(found) > 20 and all(r["tasks"] == 1 and r["words"] <= 500 for r in found)
    for limit in (7, None):
        assert sorted(rows(index.search("rare seldom note", limit, boosts={"body": 1.0}))) == sorted(rows(search.bm25(df, "rare seldom note", limit, boosts={"body": 1.0}, columns={"body": F.col("body")})))
