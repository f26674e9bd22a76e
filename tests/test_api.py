"""The collection object over a folder, and model files."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.api import Collection, register_functions
from marginalia.functions import text as tx
from marginalia.functions import vectors as vx
from marginalia.operators import save, sync, tags
from marginalia.sources.model import read_tensors, token_table


@pytest.fixture()
def vault(spark, tmp_path):
    for i, (name, kind, gist, tag) in enumerate([("one", "note", "graph databases and queries", "db"), ("two", "term", "graph queries at scale", "db"), ("three", "note", "baking bread", "food"), ("four", "term", "graph databases", "db, scale")]):
        (tmp_path / f"{name}.md").write_text(f"---\nnote_type: {kind}\nnote_status: active\nnote_area: tech\nnote_gist: {gist}\nnote_tags: [{tag}]\n---\n[[one]] [[gone{i}]]\n")
    return Collection.open(spark, str(tmp_path))


def names(df):
    return [r["title"] for r in df.collect()]


def test_reading(vault):
    assert names(vault.search("bread", 1)) == ["three"] and set(names(vault.search("graph", 5, type="term"))) == {"two", "four"}
    assert "one" not in names(vault.related("one", 2)) and names(vault.related("one", 5, boost_type=True))[0] in ("four", "three", "two") and vault.related("nobody").count() == 0
    assert names(vault.get_note("two")) == ["two"] and names(vault.list_notes(type="note")) == ["one", "three"]
    totals, counts = vault.status()
    assert totals.first()["health"] == 100 and {tuple(r) for r in counts.collect()} >= {("type", "note", 2)}
    checks, violations = vault.audit(verbose=True)
    assert {r["check"]: r["status"] for r in checks.collect()}["wikilinks"] == "fail" and violations.count() == 0
    assert [tuple(r)[:2] for r in vault.suggest_tags("three", similar=3).collect()] == [("db", 3)] and len(names(vault.recent(2))) == 2


def test_saving(spark, vault, tmp_path):
    assert vault.save("new", "text", tags_=[" a ", "a"], gist="brand new things")[0] == "created"
    assert vault.save("one", "text")[0] == "exists" and vault.save("../x", "text")[0] == "invalid"
    assert vault.save("one", "more", "append")[0] == "appended" and (tmp_path / "one.md").read_text().endswith("\n\nmore")
    assert vault.save("two", "anew", "update", type="log")[0] == "updated" and "note_type: log" in (tmp_path / "two.md").read_text()
    assert vault.save("nobody", "x", "append")[0] == "not found"
    decision, close = vault.save("like three", "x", "smart", gist="baking bread")
    assert decision == "needs_decision" and close.first()["name"] == "three"
    assert vault.save("memo", "note this", "inbox")[0] == "appended to inbox" and "note this" in vault.get_inbox().first()["content"]
    vault.clear_inbox()
    assert (tmp_path / "inbox.md").read_text() == ""
    assert (tmp_path / "Notes/new.md").read_text().count("note_tags: [a]") == 1
    with pytest.raises(ValueError):
        vault.save("x", "y", "guess")


def test_tags(spark, vault):
    catalogue = tags.seed_catalogue(spark).withColumn("vec", vx.embed(F.col("description")))
    assert vault.tags_suggest("running on kubernetes", catalogue).first()["tag"] == "k8s"
    assert "kubernetes" in {r["tag"] for r in vault.tags_suggest("kubernetes kubernetes", catalogue, 9, discover=True).collect()} | {"kubernetes"}
    assert vault.tags_list(catalogue).count() == catalogue.count() and vault.tags_analyze(catalogue, 0.999).count() == 0


def test_saving_with_suggested_tags(spark, vault, tmp_path):
    catalogue = tags.seed_catalogue(spark)
    assert vault.save("clusters", "text", gist="kubernetes and cuda", tags_=["own"], catalogue=catalogue)[0] == "created"
    assert "note_tags: [own, cuda, k8s]" in (tmp_path / "Notes/clusters.md").read_text()
    vault.save("plain", "text", gist="kubernetes and cuda", auto_tag=False, catalogue=catalogue)
    vault.save("few", "text", gist="kubernetes and cuda", tag_limit=1, catalogue=catalogue)
    assert "note_tags" not in (tmp_path / "Notes/plain.md").read_text() and "note_tags: [cuda]" in (tmp_path / "Notes/few.md").read_text()


def test_stored_index(spark, vault, tmp_path):
    before = {m: [tuple(r) for r in vault.search("graph queries", 3, mode=m).collect()] for m in ("keyword", "semantic", "hybrid")}
    index = vault.reindex(str(tmp_path / ".index"))
    assert index.notes == 4 and {m: [tuple(r) for r in vault.search("graph queries", 3, mode=m).collect()] for m in before} == before
    vault.clear_index(str(tmp_path / ".index"))
    assert not (tmp_path / ".index").exists() and names(vault.search("bread", 1)) == ["three"]
    assert names(vault.complete("see [[baking br")) [:1] == ["three"] and vault.complete("see [[b").count() == 0


def test_reindexing_and_syncing(spark, vault, tmp_path):
    folder, embedded = str(tmp_path / ".index"), lambda i: {r["path"]: r["segment"] for r in i.docs().collect()}
    for _ in range(3):
        index = vault.reindex(folder)
        assert index.notes == 4 and names(vault.search("bread", 1)) == ["three"]
    version = index.segments()[0]
    old = {r["path"]: r["vec"] for r in index.docs().collect()}
    (tmp_path / "three.md").write_text("---\nnote_type: note\nnote_gist: sailing boats\n---\n")
    (tmp_path / "four.md").unlink()
    (tmp_path / "five.md").write_text("---\nnote_gist: bread and boats\n---\n")
    index = vault.sync(folder)
    assert {p: s > version for p, s in embedded(index).items()} == {"one.md": False, "two.md": False, "three.md": True, "five.md": True}
    assert set(names(vault.search("boats", 5, mode="keyword"))) == {"three", "five"} and names(vault.search("sailing boats", 1, mode="semantic")) == ["three"]
    assert {r["path"]: r["vec"] for r in index.docs().collect()}["three.md"] != old["three.md"]
    again = Collection.open(spark, str(tmp_path))
    assert again.open_index(folder).notes == 4 and names(again.search("sailing boats", 1)) == ["three"]
    (tmp_path / "three.md").write_text("---\nnote_gist: knitting\n---\n")
    vault.reindex(folder)
    assert names(vault.search("knitting", 1)) == ["three"] and names(vault.search("bread", 9, mode="keyword")) == ["five"]
    with pytest.raises(ValueError, match="no index"):
        again.open_index(str(tmp_path / "nowhere"))


def test_vectors_are_looked_up_in_their_index(spark, vault, tmp_path):
    ask = lambda: [[tuple(r) for r in x.collect()] for x in (vault.search("graph queries", 3, mode="semantic"), vault.search("graph queries", 3), vault.related("one", 3), vault.related("one", 2, boost_type=True))]
    before = ask()
    index = vault.index_vectors(str(tmp_path / ".vectors"))
    assert index.rows().count() == 4 and ask() == before
    kept = vault.index_vectors(str(tmp_path / ".vectors"))
    assert len(kept._state()) == 1  # nothing has changed
    notes = vault.notes.persist()
    vault.notes = notes.filter("name <> 'two'").withColumn("vec", F.when(F.col("name") == "three", vault.embedder.column(F.lit("sailing boats"))).otherwise(F.col("vec")))
    vault.index_vectors(str(tmp_path / ".vectors"))
    assert index.rows().count() == 3 and names(vault.search("sailing boats", 1, mode="semantic")) == ["three"]
    vault.notes = notes
    assert "two" not in names(vault.search("graph queries", 4, mode="semantic")) and "two" in names(vault.search("graph queries", 4, mode="semantic", prefilter=True))


def test_frontmatter_that_is_nested_too_deeply(spark, tmp_path):
    for name, raw in (("deep", "[" * 100_000), ("plain", "a: 1"), ("closed", "[" * 3000 + "]" * 3000)):
        (tmp_path / f"{name}.md").write_text(f"---\n{raw}\n---\n")
    checks, found = Collection.open(spark, str(tmp_path)).audit(verbose=True)
    assert {r["name"] for r in found.filter("code = 'yaml_syntax'").collect()} >= {"deep"} and checks.count() == 6


def test_restoring(spark, vault, tmp_path):
    folder = tmp_path / "exported"
    assert save.restore_index(spark, str(folder)) is None
    vectors = vault.notes.select("path", "vec")
    assert save.export_index(vault.index_rows(), vectors, str(folder)) and save.restore_index(spark, str(folder)).count() == 4
    vectors.limit(0).write.mode("overwrite").parquet(f"{folder}/vectors")
    assert save.restore_index(spark, str(folder)) is None and not (folder / "vectors").exists()
    (folder / "vectors").mkdir()
    (folder / "vectors" / "part-0.parquet").write_bytes(b"damaged")
    assert save.restore_index(spark, str(folder)) is None and not (folder / "vectors").exists()


def subword_tokenizer() -> str:
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordPiece({"[UNK]": 0, "graph": 1, "##s": 2, "data": 3, "##base": 4, "bread": 5, "a": 6}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    return t.to_str()


def test_subwords(spark):
    rows = np.array([[0, 0, 0], [1, 0, 0], [0.5, 0.5, 0], [0, 1, 0], [0, 1, 1], [0, 0, 1]], float)
    e = vx.SubwordEmbedder(rows, subword_tokenizer())
    assert e.words("graphs database") == [("graphs", [1, 2]), ("database", [3, 4])]
    mean = rows[[1, 2]].mean(axis=0)
    assert e.query("graphs") == pytest.approx(mean / np.sqrt(mean @ mean)) and not e.query("").any() and not e.query("a").any()
    got = spark.createDataFrame([("graphs",), (None,)], "t string").select(e.column(F.col("t")).alias("v")).collect()
    assert got[0]["v"] == pytest.approx(list(e.query("graphs"))) and got[1]["v"] == [0, 0, 0]
    assert tags.keywords("bread bread graph", e, 1)[0][0] == "bread"
    found = tags.keyword_rows(spark.createDataFrame([(1, "bread bread graph")], "doc_id int, text string"), e).collect()
    assert {r["tag"] for r in found} == {"bread", "graph"}


def test_sql_functions(spark):
    register_functions(spark)
    assert spark.sql("SELECT bm25(2, 10, 8, 3, 100) AS s").first()["s"] == pytest.approx(np.log(1 + 97.5 / 3.5) * 2.2 * 2 / (2 + 1.2 * (0.25 + 0.75 * 10 / 8)))
    row = spark.sql("SELECT htp_embed('graph') AS v, cosine(htp_embed('graph x'), htp_embed('GRAPH, x')) AS c, cosine(array(1D), array(1D, 2D)) AS z").first()
    assert row["c"] == pytest.approx(1) and row["z"] == 0 and row["v"] == pytest.approx(list(vx.embed_text("graph")))


def test_meta_and_blobs(spark):
    meta, vectors = spark.createDataFrame([("dimension", "256")], "key string, value string"), spark.range(3)
    new, left = sync.clear_on_dimension_change(meta, vectors, 384)
    assert sync.get_meta(new, "dimension") == "384" and left.count() == 0 and sync.get_meta(new, "x") is None
    assert sync.clear_on_dimension_change(new, vectors, 384)[1].count() == 3
    rows = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    got = rows.select(vx.to_blob(F.col("v")).alias("b")).select("b", vx.from_blob(F.col("b")).alias("v")).collect()
    assert bytes(got[0]["b"]) == struct.pack("<ff", 1.5, -2.0) and got[0]["v"] == [1.5, -2.0] and got[1]["v"] is None
    lines = spark.createDataFrame([("a [[no",), ("a [[n",), ("a [[x]] b",)], "l string")
    assert [r[0] for r in lines.select(tx.completion_prefix(F.col("l"))).collect()] == ["no", None, None]


def test_model_files(tmp_path):
    rows = {"F32": np.array([[1, 2], [3, 4]], "<f4"), "F16": np.array([[0.5, 2]], "<f2")}
    bf = np.array([[1.0, -2.0]], "<f4").view("<u4") >> 16
    blobs = [rows["F32"].tobytes(), rows["F16"].tobytes(), bf.astype("<u2").tobytes()]
    ends = np.cumsum([0] + [len(b) for b in blobs]).tolist()
    head = {n: {"dtype": t, "shape": s, "data_offsets": ends[i : i + 2]} for i, (n, t, s) in enumerate((("embeddings", "F32", [2, 2]), ("h", "F16", [1, 2]), ("b", "BF16", [1, 2])))}
    text = json.dumps(head).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(text)) + text + b"".join(blobs))
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"▁Cat": 0, "##dog": 1, "beyond": 7}}}))
    got = read_tensors(str(tmp_path / "m.safetensors"))
    assert got["h"].tolist() == [[0.5, 2]] and got["b"].tolist() == [[1, -2]]
    table = token_table(str(tmp_path / "m.safetensors"), str(tmp_path / "t.json"))
    assert table == {"cat": [1, 2], "dog": [3, 4]} and vx.create_embedder(table).dimension == 2
