"""Sketches of field values, merged over batches, against counts of everything."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.operators.sketches import ERROR, FieldSketches

SCHEMA = "path string, field string, kind string, values array<string>"


def made():
    """A skewed field of many values, a flat one, one of few values, ties, nulls and numbers, in three batches."""
    rng, batches = random.Random(8), []
    for b in range(3):
        rows = [(f"{b}-{i}", "skewed", "string", [f"v{min(int(rng.paretovariate(0.7)), 50_000)}"]) for i in range(8000)]
        rows += [(f"{b}-{i}", "flat", "array", [f"f{rng.randrange(4000)}", f"g{b}{i}"]) for i in range(2000)]
        rows += [(f"{b}-{i}", "few", "string", [("b", "a", None)[i % 3]]) for i in range(30)]
        rows += [(f"{b}", "number", "number", ["1"]), (f"{b}", "empty", "array", []), (f"{b}", "long", "string", ["x" * 200])]
        batches.append(rows)
    return batches


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    sketches, batches = FieldSketches(spark, str(tmp_path_factory.mktemp("sketches")), tracked=200), made()
    sketches.add(spark.createDataFrame(batches[0], SCHEMA), 1)  # is replaced
    for b, rows in enumerate(batches):
        sketches.add(spark.createDataFrame(rows, SCHEMA), b)
    counts = {}
    for rows in batches:
        for _, field, kind, values in rows:
            for v in values if kind != "number" else []:
                if v is not None and (kind == "array" or len(v) < 100):
                    counts.setdefault(field, Counter())[v] += 1
    return sketches, counts


@pytest.mark.parametrize("k", [1, 10])
def test_top_values_are_exact(kept, k):
    sketches, counts = kept
    got = {}
    for r in sketches.top(k).orderBy("field", "place").collect():
        got.setdefault(r["field"], []).append((r["value"], r["n"]))
    assert got == {f: sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k] for f, c in counts.items()}


def test_estimates_are_within_their_bounds(kept):
    sketches, counts = kept
    by = {r["field"]: r for r in sketches.profile().collect()}
    assert set(by) == set(counts)
    for field, c in counts.items():
        assert by[field]["n"] == sum(c.values()) and by[field]["error"] == pytest.approx(ERROR / 200 * sum(c.values()))
        assert abs(by[field]["distinct"] - len(c)) <= 0.04 * len(c)
    estimates = sketches.merged().selectExpr("field", "inline(approx_top_k_estimate(frequent, 200))").collect()
    assert estimates and all(abs(r["count"] - counts[r["field"]][r["item"]]) <= by[r["field"]]["error"] for r in estimates)


def test_only_what_cannot_be_ruled_out_is_counted(kept):
    """Few values of the skewed field are counted; the flat one, and that of few values, are counted whole."""
    sketches, counts = kept
    told = Counter(r["field"] for r in sketches.candidates(3).collect())
    assert set(told) == {"skewed"} and told["skewed"] < len(counts["skewed"]) / 20


def test_values_are_read_once_a_batch(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def read(x):
        seen.add(1)
        return x

    rows = [(f"{i}", "words", "array", ["often"] * 5000 + [f"w{i % 7}", f"r{i}", None]) for i in range(20)]
    once = F.udf(read, "string").asNondeterministic()
    fields = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("field", once("field"))
    sketches = FieldSketches(spark, str(tmp_path / "sketches"))
    sketches.add(fields, 0)
    assert seen.value == 20
    (row,) = sketches.profile().collect()
    assert (row["field"], row["n"], row["distinct"]) == ("words", 20 * 5002, 28)
    assert [(r["value"], r["n"]) for r in sketches.top(2).orderBy("place").collect()] == [("often", 100_000), ("w0", 3)]
