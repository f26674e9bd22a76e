"""The index that is kept up against one that is built anew."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import search
from marginalia.operators.segments import SegmentedIndex

NOTES = "path string, gist string, tags array<string>, changed bigint"
QUERIES = ("alpha", "beta gamma", "+alpha -beta", '"alpha beta"', "title:note alpha", "gist:delta", "epsilon", "nothing-has-this")


def notes(spark, rng, ids, stamp=0):
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta eta"])
    data = [(f"Notes/note {i}.md", rng.choice([None, " ".join(word() for _ in range(rng.randrange(0, 9)))]), [word() for _ in range(rng.randrange(0, 3))], stamp) for i in ids]
    return data, spark.createDataFrame(data, NOTES)


def same(index, spark, held: dict, queries=QUERIES[1:3]):
    """The index finds in its segments what a scan of the notes that should be in it finds."""
    rows = spark.createDataFrame(list(held.values()), NOTES)
    for q in queries:
        want = [(r["path"], r["score"]) for r in search.bm25(rows, q, 50).select("path", "score").collect()]
        got = [(r["path"], r["score"]) for r in index.search(q, 50).collect()]
        assert [p for p, _ in got] == [p for p, _ in want], q
        assert all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(got, want, strict=True)), q
    assert {r["path"] for r in index.docs().collect()} == set(held) and index.notes == len(held)


def test_adding_changing_removing_and_compacting(spark, tmp_path):
    rng, index, held = random.Random(1), SegmentedIndex(spark, str(tmp_path / "index")), {}
    assert index.search("alpha", 5).collect() == [] and index.segments() == [] and index.notes == 0
    for ids in (range(0, 60), range(40, 80), range(75, 90)):
        data, df = notes(spark, rng, ids)
        index.add(df)
        held |= {r[0]: r for r in data}
    same(index, spark, held)
    index.remove(spark.createDataFrame([(f"Notes/note {i}.md",) for i in (3, 41, 77, 1000)], "path string"))
    held = {k: v for k, v in held.items() if k not in {f"Notes/note {i}.md" for i in (3, 41, 77)}}
    data, df = notes(spark, rng, [3])  # a note comes back
    index.add(df)
    held |= {r[0]: r for r in data}
    same(index, spark, held)
    same(index, spark, held, QUERIES)
    assert index.segments() == [0, 1, 2, 3, 4]
    before = SegmentedIndex(spark, index.folder, version=4)
    assert index.compact() == 5 and index.segments() == [5]
    same(index, spark, held)
    same(before, spark, held)  # a reader of the version before goes on
    data, df = notes(spark, rng, range(20, 30))
    index.add(df)
    held |= {r[0]: r for r in data}
    assert index.drop_old() == [0, 1, 2, 3, 4] and index.segments() == [5, 6]
    same(index, spark, held)


def test_postings_are_written_from_where_they_are(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        if "/postings/" in path:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    rng, index, held = random.Random(8), SegmentedIndex(spark, str(tmp_path / "index")), {}
    for ids in (range(0, 60), range(40, 80)):
        data, df = notes(spark, rng, ids)
        index.add(df)
        held |= {r[0]: r for r in data}
    index.compact()
    assert len(plans) == 3 and not any("Exchange hashpartitioning" in p or "Sort [" in p for p in plans)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    same(index, spark, held)
    twice, more = [notes(spark, rng, ids, stamp) for ids, stamp in ((range(70, 90), 1), (range(85, 95), 2))]
    index.add(twice[1].unionByName(more[1]).unionByName(more[1]), order="changed")  # some keys have three rows, some of them alike
    held |= {r[0]: r for r in twice[0] + more[0]}
    same(index, spark, held)


def test_postings_of_all_parts_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    sc, write, group = spark.sparkContext, DataFrameWriter.parquet, f"postings-{tmp_path.name}"
    conf, name = sc._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"

    def parquet(self, path, *args, **kwargs):
        if "/postings/" not in path:
            return write(self, path, *args, **kwargs)
        sc.setJobGroup(group, "postings")
        conf.set(name, "50")  # a sort of more rows spills
        try:
            return write(self, path, *args, **kwargs)
        finally:
            conf.remove(name)
            sc.setLocalProperty("spark.jobGroup.id", None)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    index = SegmentedIndex(spark, str(tmp_path / "index"), "doc_id", {"body": F.col("body")}, kind="bigint")
    index.add(spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.concat(F.lit("w"), i.cast("string")))).alias("body")).coalesce(2))
    index.compact()
    assert index.postings().count() == 40 * 500 and index.postings().select("part").distinct().count() == 64
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = [s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds]
    held = [sc._jsc.sc().statusStore().lastStageAttempt(s) for s in stages]
    wrote = [x for x in held if x.outputRecords() == 40 * 500]
    assert len(wrote) == 2 and not any(x.memoryBytesSpilled() or x.diskBytesSpilled() for x in wrote)


def test_unchanged_notes_are_not_written_again(spark, tmp_path):
    data, df = notes(spark, random.Random(2), range(50))
    index = SegmentedIndex(spark, str(tmp_path))
    index.add(df)
    index.add(df.withColumn("gist", F.when(F.col("path") == "Notes/note 7.md", F.lit("quite new")).otherwise(F.col("gist"))))
    assert [r["path"] for r in index._of("docs", index.docs_schema, [1]).collect()] == ["Notes/note 7.md"]
    assert [r["path"] for r in index.search("quite", 5).collect()] == ["Notes/note 7.md"]


def test_a_run_that_stops_changes_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch):
    rng, index = random.Random(3), SegmentedIndex(spark, str(tmp_path))
    data, df = notes(spark, rng, range(30))
    index.add(df)
    held = {r[0]: r for r in data}
    more, changed = notes(spark, rng, range(10, 40))
    with monkeypatch.context() as m:
        m.setattr(SegmentedIndex, "_commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("the driver is gone")))
        with pytest.raises(RuntimeError):
            index.add(changed, segment=1)
    same(index, spark, held)
    held |= {r[0]: r for r in more}
    for _ in range(2):  # running it again, and once more under its number, gives the same
        assert index.add(changed, segment=1) == 1
        same(index, spark, held)


def test_whole_collections_repeated_rows_and_missing_keys(spark, tmp_path):
    rng, index = random.Random(4), SegmentedIndex(spark, str(tmp_path))
    data, df = notes(spark, rng, range(20))
    index.add(df.unionByName(df).unionByName(spark.createDataFrame([(None, "alpha", [], 0)], NOTES)))
    held = {r[0]: r for r in data}
    same(index, spark, held)
    old, first = notes(spark, rng, range(5, 12), stamp=1)
    new, last = notes(spark, rng, range(5, 12), stamp=2)
    index.add(first.unionByName(last), whole=True, order="changed")
    same(index, spark, {r[0]: r for r in new})
    index.add(spark.createDataFrame([], NOTES), whole=True)
    assert index.notes == 0 and index.docs().count() == 0 and index.search("alpha", 5).collect() == []


def test_kept_columns_are_computed_for_changed_notes(spark, tmp_path):
    data, df = notes(spark, random.Random(5), range(8))
    index = SegmentedIndex(spark, str(tmp_path), kept="length int, gist string")
    carry = {"length": F.char_length(F.coalesce("gist", F.lit("")))}
    index.add(df, carry=carry, needs=["gist"])
    index.add(df.withColumn("gist", F.when(F.col("path") == "Notes/note 2.md", F.lit("12345")).otherwise(F.col("gist"))), carry=carry, needs=["gist"])
    got = {r["path"]: (r["length"], r["segment"]) for r in index.docs().collect()}
    assert got["Notes/note 2.md"] == (5, 1) and sum(s for _, s in got.values()) == 1
    assert all(n == len(r[1] or "") for r in data for n, s in [got[r[0]]] if s == 0)


def test_a_search_reads_the_parts_of_its_terms(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path))
    index.add(notes(spark, random.Random(6), range(30))[1])
    plan = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters:")[1].split("]")[0] and "In(term" in plan or "EqualTo(term" in plan
