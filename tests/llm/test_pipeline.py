"""Each stage on its own input, and all of them over tables on disk."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm.mix import mix
from marginalia.llm.near_dedup import near_duplicates

from . import corpus
from .test_decontaminate import brute as contaminated
from .test_near_dedup import brute as components


def tables(spark, folder, docs=None):
    rng = random.Random(21)
    items = [(i, " ".join(corpus.words(rng, 20))) for i in range(5)]
    if docs is None:
        docs = corpus.rows()
        docs += [(900 + i, " ".join(corpus.words(rng, 20) + t.split()[:15] + corpus.words(rng, 20)), "en", "b", 0) for i, t in items]
        docs += [(950 + i, " ".join(x.upper() + "###" for x in corpus.words(rng, 60)), "en", "c", 0) for i in range(30)]
    labels = [(d[0], 0 if d[0] >= 950 else 1, 0) for d in docs if d[0] is not None]
    for name, rows, schema in (("documents", docs, corpus.DOCS), ("benchmark", items, "item_id bigint, text string"), ("labels", labels, "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return docs, items


def test_stages(spark, tmp_path):
    data, items = tables(spark, str(tmp_path))
    docs, folder = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near-dedup", "decontamination", "mixing", "sharding"]

    good = corpus_pipeline.quality(spark, docs, folder)
    kept = {r["doc_id"] for r in good.collect()}
    assert not kept & set(range(950, 980)) and set(range(900, 905)) <= kept and good.columns == docs.columns

    once = corpus_pipeline.near_dedup(spark, docs, folder)
    expected = components({d[0]: d for d in data if d[0] is not None}.values())
    got = [r["doc_id"] for r in once.collect()]
    assert sorted(x for x in got if x is not None) == sorted(i for i, (_, c) in expected.items() if i == c) and once.columns == docs.columns

    clean = corpus_pipeline.decontamination(spark, docs, folder)
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(d[0]) for d in data if not contaminated(d[1], items)[4])

    mixed = corpus_pipeline.mixing(spark, docs, folder).collect()
    taken = {r["doc_id"]: r for r in mix(docs).collect() if r["doc_id"] is not None and r["size"]}
    times = {i: sum(r["doc_id"] == i for r in mixed) for i in taken}
    repeated = [i for i in taken if sum(d[0] == i for d in data) > 1]
    assert all(abs(times[i] - taken[i]["taken"] / taken[i]["size"]) <= 0.5 for i in taken if i not in repeated)

    placed = corpus_pipeline.sharding(spark, docs, folder)
    assert placed.count() == len(data) and placed.columns == [*docs.columns, "slot", "shard"]


def test_columns_of_any_name_stay(spark, tmp_path):
    """Columns named like what the stages use inside, through every stage."""
    tables(spark, str(tmp_path))
    docs = corpus.frame(spark, [(i, " ".join([f"w{i}"] * 30 + ["a", "b", "c"]), "en", "a", 0) for i in range(20)] + [(3, "more " * 40, "en", "a", 0), (None, "no id " * 30, "en", None, 0)])
    for name in ("key", "row", "copy", "times", "kept", "n", "order", "size", "_key", "_times", "_copy", "taken", "score", "d", "id"):
        docs = docs.withColumn(name, F.lit(f"keep {name}"))
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(got.columns) and got.count() > 0
        for r in got.collect():
            assert all(r[c] == f"keep {c}" for c in ("key", "row", "copy", "times", "kept", "n", "order", "_key", "_times", "_copy", "taken", "d", "id"))


def test_near_dedup_links_from_four_fifths_up(spark):
    """Copies with similarities between 0.80 and 0.85 go in the pipeline, though op1 keeps them; less similar ones stay."""
    w = [f"w{i}" for i in range(104)]  # 100 shingles
    docs = [(i, " ".join(w[:k] + [f"x{i}_{j}" for j in range(104 - k)]), "en", "a", 0) for i, k in ((0, 104), (1, 94), (2, 90))]  # 90 / 110 and 86 / 114
    docs = corpus.frame(spark, docs, extra=False)
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near-dedup"](spark, docs, "").orderBy("doc_id").collect()] == [0, 2]
    assert all(r["kept"] for r in near_duplicates(docs).collect())


def test_run(spark, tmp_path):
    data, _ = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).persist()
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(docs)


def test_run_on_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
