"""Rankings of a small collection, fusion, and search modes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import vectors as vx
from marginalia.operators import ann, knn, search

NOTES = [
    ("alpha.md", "alpha", "Work note gist for smoke tests.", ["alpha", "demo"], "note", "work"),
    ("beta.md", "beta", "Tech term gist for smoke tests.", ["beta"], "term", "tech"),
    ("gamma.md", "gamma", "Learning project gist for smoke tests.", [], "project", "learning"),
]
SEMANTIC = {"work note": "alpha", "note gist": "alpha", "tech term": "beta", "term gist": "beta", "learning project": "gamma", "project gist": "gamma"}
HYBRID = {"alpha": "alpha", "demo": "alpha", "work note": "alpha", "beta": "beta", "tech term": "beta", "gamma": "gamma", "learning project": "gamma", "learning": "gamma"}


@pytest.fixture(scope="module")
def notes(spark):
    df = spark.createDataFrame(NOTES, "path string, name string, gist string, tags array<string>, type string, area string")
    return df.withColumn("vec", vx.embed(F.col("gist"))).persist()


@pytest.mark.parametrize(("mode", "goldens", "most"), [("semantic", SEMANTIC, 1), ("hybrid", HYBRID, 2)])
def test_golden_rankings(notes, mode, goldens, most):
    for query, expected in goldens.items():
        names = [r["name"] for r in search.search(notes, query, 3, mode).collect()]
        assert names.index(expected) < most, (query, names)


def test_modes_and_plans():
    assert [search.parse_mode(x) for x in ("SEMANTIC", "bm25", "Keyword", "hybrid", "what", None)] == ["semantic", "keyword", "keyword", "hybrid", "hybrid", "hybrid"]
    plan = search.plan_search(0, "semantic", type="note", area=None)
    assert (plan.limit, plan.fetch, plan.filters) == (5, 25, {"type": "note"})
    assert search.plan_search(1000, None, type="x").fetch == 500 and search.plan_search(1000).limit == 100 and search.plan_search(-3).limit == 1
    assert search.parse_query("type:term vectors type:note area:tech") == ("vectors", {"type": "term", "area": "tech"})
    assert search.parse_query("tag:x", type="log") == ("note", {"tag": "x", "type": "log"})


def test_filters_after_and_before(notes):
    assert [r["name"] for r in search.search(notes, "gist", 3, "keyword", area="tech").collect()] == ["beta"]
    assert search.search(notes, "alpha", 3, "keyword", area="tech").count() == 0
    assert [r["name"] for r in search.search(notes, "smoke", 3, "semantic", prefilter=True, area="tech").collect()] == ["beta"]
    hits = notes.withColumn("score", F.lit(1.0))
    assert [r["name"] for r in search.filter_hits(hits, 5, {"tag": "demo"}).collect()] == ["alpha"]
    assert [r["name"] for r in search.filter_hits(hits, 1, {}, ["beta", "demo"]).collect()] == ["alpha"]


def test_bm25_corpus(spark):
    rows = [("a/rust-programming.md", "Systems language", ["rust"]), ("python-basics.md", "Programming for beginners", ["python"]), ("ml.md", "Machine Learning intro", ["ml", "ai"]), ("empty.md", None, [])]
    df = spark.createDataFrame(rows, "path string, gist string, tags array<string>")
    top = lambda q: [r["path"] for r in search.bm25(df, q, 5).collect()]
    assert top("rust") == ["a/rust-programming.md"] and top("programming")[0] == "a/rust-programming.md" and len(top("programming")) == 2
    assert top("ml") == ["ml.md"] and top("absent") == [] and top("?!") == []
    assert search.bm25(df, "rust", 5, boosts={"gist": 1.0}).count() == 0
    df2 = df.withColumn("doc_id", F.monotonically_increasing_id())
    stats = {(r["field"], r["term"]): (r["df"], r["cf"]) for r in search.df_stats(df2).collect()}
    assert stats["title", "programming"] == (1, 1) and stats["gist", "programming"] == (1, 1)


def test_fusion(spark):
    ranks = lambda *names: spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "path string, rank int")
    scores = lambda **lists: {r["path"]: r["score"] for r in search.fuse(lists, {"semantic": 1.0, "bm25": 1.0}).collect()}
    assert scores(semantic=ranks(), bm25=ranks()) == {}
    assert scores(semantic=ranks("a"), bm25=ranks()) == {"a": pytest.approx(1 / 61)}
    both = scores(semantic=ranks("a", "b"), bm25=ranks("b", "c"))
    assert both["b"] == pytest.approx(1 / 62 + 1 / 61) and both["c"] == pytest.approx(1 / 62)


def test_simple_search(notes):
    rows = search.simple_search(notes, "work gist zebra", 5).collect()
    assert rows[0]["name"] == "alpha" and rows[0]["score"] == pytest.approx(2 / 3) and len(rows) == 3
    assert search.simple_search(notes, "  ", 5).count() == 0


def test_vectors(spark):
    assert len(vx.MODULI) == 192 and vx.MODULI[0] == 2 and vx.MODULI[-1] == 1163
    a = vx.embed_text("Hello, wörld! 한국어")
    assert len(a) == 384 and abs(a @ a - 1) < 1e-9 and not vx.embed_text("...").any()
    words = ["a", "programming", "swimming", "한국어", "😀x", "x" * 100, "ab😀cd"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", vx.token_number(F.col("w")).alias("n"), vx.token_vector(F.col("w")).alias("v"), vx.embed(F.col("w")).alias("e")).collect()
    for r in rows:
        assert int(r["n"]) == vx._number(r["w"])
        assert max(abs(x - y) for x, y in zip(r["v"], vx.token_matrix([r["w"]])[0])) < 1e-9
        assert max(abs(x - y) for x, y in zip(r["e"], vx.embed_tokens([r["w"]]))) < 1e-12
    assert rows[1]["n"] == rows[2]["n"]
    pairs = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([1.0], [-1.0]), ([0.0], [1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in pairs.select(vx.cosine(F.col("a"), F.col("b"))).collect()] == [1, 0, -1, 0, 0]


def test_table_embedder(spark):
    e = vx.create_embedder({"cat": [1.0, 0.0], "dog": [0.0, 1.0]})
    got = spark.createDataFrame([("Cat dog",), ("none",)], "t string").select(e.column(F.col("t")).alias("v")).collect()
    assert got[0]["v"] == pytest.approx([0.5**0.5] * 2) and got[1]["v"] == [0, 0] and list(e.query("dog")) == [0, 1]
    assert vx.create_embedder().dimension == 384


def test_knn(spark):
    rows = [(i, [float(i % 5 + 1), float(i % 3), 1.0], i % 2) for i in range(40)] + [(99, None, 0), (98, [1.0], 0)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int")
    good = df.filter("id < 90")
    joined = knn.knn_join(df, good.filter("id % 7 = 0"), 3, "id", "v").collect()
    assert len(joined) == 6 * 3 and all(r["id"] != r["query_id"] for r in joined)
    for q in (0, 7):
        vec = good.filter(F.col("id") == q).first()["v"]
        alone = [r["id"] for r in knn.knn(good.filter(F.col("id") != q), "v", vec, 3).collect()]
        assert [r["id"] for r in sorted(joined, key=lambda r: r["rank"]) if r["query_id"] == q] == alone
        assert [r["id"] for r in knn.related(good, "v", q, 3, "id").collect()] == alone
    assert knn.related(good, "v", 1234, 3, "id").count() == 0
    boosted = knn.related(good, "v", 0, 5, "id", {"label": 1}).collect()
    assert boosted[0]["label"] == 1
    with pytest.raises(ValueError):
        knn.check_dimension(df, "v", 3)
    knn.check_dimension(good, "v", 3)


def test_blocks_of_queries(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id bigint, v array<double>")
    whole = sorted(map(tuple, knn.knn_join(df, df, 2, "id", "v").collect()))
    monkeypatch.setattr(knn, "BLOCK", 7)
    assert sorted(map(tuple, knn.knn_join(df, df, 2, "id", "v").collect())) == whole


def test_passes_lose_no_query(spark, monkeypatch):
    """Queries that share an id are all asked, wherever a pass ends."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i // 3, [float(x) for x in rng.normal(size=4)]) for i in range(30)], "id bigint, v array<double>")
    whole = sorted(map(tuple, knn.knn_join(df, df, 2, "id", "v").collect()))
    monkeypatch.setattr(knn, "SENT", 4)
    assert [len(ids) for ids, _ in knn.blocks(df, "id", "v")] == [6, 6, 6, 6, 6]
    assert sorted(map(tuple, knn.knn_join(df, df, 2, "id", "v").collect())) == whole


SYNTAX = [
    ("rust", {"a", "b"}), ("+rust -python", {"a"}), ("rust python", {"a", "b", "c"}), ('"systems language"', {"a"}), ('"language systems"', {"b"}), ("title:python", {"c"}), ("gist:python", {"b"}),
    ("tags:slow rust-language", {"c"}), ("+absent rust", set()), ("-rust", set()), ('+"systems language" python', {"a"}), ("nofield:rust", set()), ('"unclosed rust', set()), ("+", set()), ("", set()),
]


def syntax_notes(spark):
    rows = [("a.md", "rust: a systems language", ["fast"]), ("b.md", "rust and python: language systems", []), ("x/python-c.md", "another language", ["slow"]), ("d.md", None, [])]
    return spark.createDataFrame(rows, "path string, gist string, tags array<string>")


def test_query_syntax_and_stored_index(spark, tmp_path):
    """Phrases, signs and fields, by a scan and out of an index on disk, with equal scores."""
    notes = syntax_notes(spark)
    index = search.StoredIndex.write(notes, str(tmp_path / "index"))
    again = search.StoredIndex(spark, str(tmp_path / "index"))
    assert index.notes == again.notes == 4
    for query, expected in SYNTAX:
        scanned = {r["path"]: r["score"] for r in search.bm25(notes, query, None).collect()}
        assert {p.removesuffix(".md")[-1] for p in scanned} == expected, query
        assert {r["path"]: r["score"] for r in again.search(query, None).collect()} == scanned, query
    plan = again.search("rust", 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_scores_of_bare_words_and_of_clauses_agree(spark):
    notes = syntax_notes(spark)
    plain, signed = ({r["path"]: r["score"] for r in search.bm25(notes, q, None).collect()} for q in ("language", "+language"))
    assert plain == signed and len(plain) == 3


def test_similar_pairs_in_blocks(spark):
    """All pairs, whatever blocks they are in; vectors of other lengths and without a direction are similar to none."""
    rng = np.random.default_rng(4)
    rows = [(f"k{i:03}", i % 3, [float(x) for x in rng.normal(size=4)]) for i in range(90)] + [("a", 0, [1.0, 0.0]), ("b", 0, [2.0, 0.0]), ("z", 0, [0.0] * 4), ("n", 0, None), ("k000", 0, [9.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "k string, g int, v array<double>")
    cos = lambda x, y: round(sum(a * b for a, b in zip(x, y)) / ((sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5 or 1), 9) if x and y and len(x) == len(y) else -1
    for on in (None, ["g"]):
        expected = sorted((a, b, round(cos(x, y), 6)) for a, g, x in rows for b, h, y in rows if a < b and (not on or g == h) and cos(x, y) >= 0.7)
        for size in (4096, 16):
            assert sorted((r["a"], r["b"], round(r["score"], 6)) for r in knn.similar_pairs(df, "k", "v", 0.7, on, size).collect()) == expected


@pytest.mark.parametrize("least", [-0.2, 0.35, 0.9, 1.0])
def test_similar_pairs_of_clusters(spark, least):
    """Each pair once, with copies that fill several blocks, and among many rows without a vector; clusters prune."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(15, 12))
    x = [centres[i % 15] + 0.08 * rng.normal(size=12) for i in range(330)] + [centres[0]] * 70
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "k bigint, v array<double>").unionByName(spark.range(1000, 9000).selectExpr("id as k", "cast(null as array<double>) as v"))
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    expected = {(i, j) for i, j in zip(*np.nonzero(np.round(u @ u.T, 9) >= least), strict=True) if i < j}
    got = [(r["a"], r["b"]) for r in knn.similar_pairs(df, "k", "v", least, rows_a_block=24).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    if least == 0.9:
        assert knn.pairs_compared(df, "k", "v", least, rows_a_block=24) < 0.35 * len(x) ** 2 / 2


@pytest.mark.parametrize("spread", [0.05, 1.0, 30.0])
def test_inverted_lists_find_the_neighbours(spark, spread):
    """Recall against the exact join, for clear clusters and for none; scores are exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + spread * rng.normal(size=16)]) for i in range(1500)] + [(5000, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").persist()
    queries, index = df.filter("id % 20 = 0"), ann.build(df, "id", "v", 5)
    found, exact = index.search(queries, 5, "id", "v"), knn.knn_join(df, queries, 5, "id", "v")
    assert ann.recall(found, exact.select("query_id", "id")) >= 0.9 and found.filter("rank = 1").count() == queries.filter("v is not null").count()
    assert found.join(exact.withColumnRenamed("score", "s"), ["query_id", "id"]).filter("abs(score - s) > 1e-9").count() == 0
    assert index.search(df.limit(0), 5, "id", "v").count() == 0 and ann.build(df.limit(0), "id", "v").search(queries, 5, "id", "v").count() == 0


def test_similar_pairs_move_few_copies(spark):
    """Where angles rule nothing out, a row goes to a bounded number of tasks, and a carried column comes with each pair."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, i % 7, [float(c) for c in v]) for i, v in enumerate(x)], "k bigint, use bigint, v array<double>")
    tasks, _ = knn._dealt(df, "k", "v", 0.2, [], 4)
    assert tasks.count() < 90 * len(x)  # 426 copies a row with a cell for each 4 rows
    u = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(np.triu(np.round(u @ u.T, 9) >= 0.6, 1))
    got = knn.similar_pairs(df, "k", "v", 0.6, rows_a_block=4, carry="use").collect()
    assert sorted((r["a"], r["b"], r["ca"], r["cb"]) for r in got) == [(a, b, a % 7, b % 7) for a, b in zip(i.tolist(), j.tolist())]


def test_rows_are_scored_in_pieces():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = rng.normal(size=(5000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000)), pa.array(x.tolist())], ["id", "v"])
    assert [b.num_rows for b in knn.pieces(iter([batch]))] == [2048, 2048, 904]
    best = knn.Best(np.arange(3), knn.unit(x[:3]), 4)
    for piece in knn.pieces(iter([batch])):
        best.add(*knn.vectors_of(piece, 0, 1, 8))
    u = knn.unit(x)
    s = np.round(u[:3] @ u.T, 9)
    s[np.arange(3), np.arange(3)] = -1
    assert best.ids.tolist() == np.argsort(-s, axis=1, kind="stable")[:, :4].tolist()


def test_postings_by_row_are_the_postings(spark):
    notes = spark.createDataFrame([(1, "b a b c", "x"), (2, "", None), (3, None, "Zz, zz: q"), (4, "a", "")], "doc_id bigint, t string, u string")
    columns = {"t": F.col("t"), "u": F.col("u")}
    rows = search.postings_by_row(notes, "doc_id", columns)
    assert sorted(map(str, rows.collect())) == sorted(map(str, search.postings(notes, "doc_id", columns).collect())) and rows.count() == 7
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_texts_are_embedded_in_pieces():
    import pyarrow as pa

    texts = [["the", "graph"], None, [], [f"w{i}" for i in range(3000)]] + [[f"t{i}"] for i in range(600)]
    got = np.array(vx._embed(pa.array(texts, pa.list_(pa.string()))).to_pylist())
    for row, tokens in zip(got, texts):
        mean = vx.token_matrix(tokens).mean(axis=0) if tokens else np.zeros(vx.DIMENSION)
        assert np.abs(row - mean / (np.sqrt(mean @ mean) or 1)).max() < 1e-12


def test_tokens_of_a_batch_are_taken_out_a_few_texts_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from marginalia.functions.vectors import _embed, embed_tokens

    texts = [[f"word{i * k % 977}" for k in range(2000)] for i in range(200)]
    tokens = pa.array(texts)
    texts = texts[::67]
    tracemalloc.start()
    found = _embed(tokens)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20_000_000  # the words of all texts at once would be some 25 MB
    assert all(abs(a - b) < 1e-12 for i, t in zip((0, 67, 134), texts, strict=False) for a, b in zip(found[i].as_py(), embed_tokens(t), strict=True))
