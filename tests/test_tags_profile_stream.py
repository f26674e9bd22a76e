"""Tags, profiles, migrations, and change feeds."""

import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marginalia.functions import vectors as vx
from marginalia.operators import profile, tags
from marginalia.sources import notes as src
from marginalia.streaming import watch


def test_seeds(spark):
    seeds = tags.seed_catalogue(spark)
    assert seeds.count() >= 28 and seeds.select("name").distinct().count() == seeds.count()
    own = spark.createDataFrame([("gpu", "mine", ["x"], 7)], seeds.schema)
    merged = tags.seed_catalogue(spark, own)
    assert merged.count() == seeds.count() and merged.filter("name = 'gpu'").first()["description"] == "mine"
    assert tags.find_tag(merged, "kubernetes").first().asDict()["aliases"] == [] and tags.find_tag(merged, "gpu").first()["aliases"] == ["x"]
    used = spark.createDataFrame([("gpu",), ("gpu",), ("rag",)], "name string")
    from marginalia.operators.save import increment_usage

    counts = {r["name"]: r["usage_count"] for r in increment_usage(merged, used).collect()}
    assert counts["gpu"] == 9 and counts["rag"] == 1 and counts["k8s"] == 0
    assert tags.list_tags(merged).first()["name"] == "gpu"


def test_suggestions(spark):
    catalogue = tags.seed_catalogue(spark).withColumn("vec", vx.embed(F.col("description")))
    texts = spark.createDataFrame([(1, "A GPU and kubernetes"), (2, "model inference serving deployment optimization"), (3, None)], "doc_id bigint, text string").withColumn("vec", vx.embed(F.col("text")))
    got = tags.best(tags.suggest(texts, catalogue), 3).collect()
    by = {(r["doc_id"], r["tag"]): (r["score"], r["reason"]) for r in got}
    assert by[1, "gpu"] == (1.0, "name") and by[1, "k8s"] == (0.95, "alias:kubernetes") and by[2, "inference"] == (1.0, "name")
    assert not any(k[0] == 3 for k in by)
    assert tags.suggest(texts, catalogue.limit(0)).count() == 0


def test_stopwords(spark):
    words = {"the": True, "search": False, "입니다": True, "구조는": True, "한국어입니다": True, "검색": False, "가": True, "cuda": False}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", tags.is_stopword(F.col("w")).alias("s")).collect()} == words


def test_suggestions_of_many_tags(spark, monkeypatch):
    """More tags than are looked for at once, aliases in turn, and vectors."""
    rows = [(f"tag{i:03}", [f"alias{i}", f"tag{(i + 1) % 50:03}"], [float(i % 7 == k) for k in range(7)]) for i in range(50)]
    texts = [(0, "Tag003 here, and alias9", [0.0] * 6 + [1.0]), (1, None, None), (2, "nothing", [1.0] + [0.0] * 6)]
    df, catalogue = spark.createDataFrame(texts, "doc_id int, text string, vec array<double>"), spark.createDataFrame(rows, "name string, aliases array<string>, vec array<double>")
    expected = set()
    for i, text, vec in texts:
        for name, aliases, own in rows:
            low = (text or "").lower()
            alias = next((a for a in aliases if a in low), None)
            cos = sum(x * y for x, y in zip(vec, own)) if vec else 0
            if name in low or alias or cos >= 0.3:
                expected.add((i, name, 1.0 if name in low else 0.95 if alias else cos, "name" if name in low else f"alias:{alias}" if alias else "semantic"))
    for most in (10_000, 7):
        monkeypatch.setattr(tags, "TAGS", most)
        assert {tuple(r) for r in tags.suggest(df, catalogue).collect()} == expected


def test_catalogue_upkeep(spark):
    catalogue = tags.seed_catalogue(spark).limit(2)
    more = tags.add_tag(tags.add_tag(catalogue, "new", "a new tag"), "new", "again")
    assert more.count() == 3 and tags.tag_count(more).first().asDict() == {"n": 3, "is_empty": False} and tags.tag_count(more.limit(0)).first()["is_empty"]
    assert tags.add_alias(more, "new", "fresh").filter("name = 'new'").first()["aliases"] == ["fresh"] and tags.add_alias(more, "none", "x").filter("array_contains(aliases, 'x')").count() == 0
    left, aliases = tags.delete_tag(more, spark.createDataFrame([("new", "fresh"), ("b", "c")], "name string, alias string"), "new")
    assert left.count() == 2 and [r["name"] for r in aliases.collect()] == ["b"]


def test_tag_vectors_are_those_of_all_gists(spark):
    rows = [("a", ["x", "y"], "graph databases"), ("b", ["x"], "baking bread today"), ("c", ["x", "z"], None)]
    notes = spark.createDataFrame(rows, "name string, tags array<string>, gist string").withColumn("path", F.col("name"))
    got = {r["name"]: r["vec"] for r in tags.tag_vectors(notes.repartition(3)).collect()}
    assert set(got) == {"x"} and got["x"] == pytest.approx(list(vx.embed_text("graph databases baking bread today c")))


def test_merges_and_similar(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0], 3), ("a", [1.0, 0.1], 3), ("c", [1.0, 0.05], 9), ("d", [0.0, 1.0], 1)], "name string, vec array<double>, usage_count bigint")
    assert {(r["keep"], r["merge"]) for r in tags.merges(df, 0.9).collect()} == {("a", "b"), ("c", "a"), ("c", "b")}
    similar = spark.createDataFrame([(["x", "y", "x"], 0.9), (["y", "z"], 0.5), (["own", "y", "z"], 0.7)], "tags array<string>, score double")
    assert [tuple(r) for r in tags.from_similar(similar, ["own"], 2).collect()] == [("y", 3, 0.9), ("z", 2, 0.7)]


def test_discovery(spark):
    texts = spark.createDataFrame([(1, "embedding vectors the of vectors")], "doc_id bigint, text string")
    found = tags.keyword_rows(texts, vx.Embedder())
    assert [(r["tag"], r["score"]) for r in found.orderBy(F.desc("score"), "tag").collect()] == [(w, pytest.approx(s)) for w, s in tags.keywords("embedding vectors the of vectors", vx.Embedder())]
    none = spark.createDataFrame([], "doc_id bigint, tag string, score double, reason string")
    assert {r["tag"] for r in tags.discover(none, found, 9, least=0.0).collect()} == {"embedding", "vectors"}
    manual = F.array(F.lit(" a "), F.lit("b"), F.lit("a"), F.lit(""))
    auto = F.array(F.lit("b"), F.lit("c"), F.lit("d"))
    row = spark.range(1).select(tags.resolve(manual, auto, 3).alias("x"), tags.resolve(manual, auto, 1, False).alias("y")).first()
    assert row["x"] == ["a", "b", "c"] and row["y"] == ["a", "b"]


def test_catalogue(spark):
    rows = [(f"{i}.md", f"n{i}", None if i == 1 else f"gist {i} " + "x" * 90, ["t"] if i < 4 else ["t", "rare"]) for i in range(5)]
    got = tags.catalogue(spark.createDataFrame(rows, "path string, name string, gist string, tags array<string>")).collect()
    assert len(got) == 1 and got[0]["usage_count"] == 5
    assert got[0]["description"] == "t. Used in contexts like: " + "; ".join([rows[0][2], "n1", rows[2][2]])[:200]


NOTES = [
    ("a.md", "---\nCategory: Idea Note\nsummary: >\n  long\n  text\nkeywords: [x, 'y']\ndone: true\nrank: 3.5\n---\nA"),
    ("b.md", "---\nCategory: term\nDomain: Technology\nkeywords: [x]\n---\nB"),
    ("f/c.md", "no frontmatter"),
]


def test_profile(spark):
    notes = spark.createDataFrame(NOTES, "path string, content string")
    fields = profile.scan_fields(notes)
    got = {r["field"]: r for r in profile.field_profile(fields).collect()}
    assert got["Category"]["n"] == 2 and got["Category"]["coverage"] == 1 and got["keywords"]["data_type"] == "array" and got["rank"]["data_type"] == "number" and got["done"]["data_type"] == "boolean"
    top = profile.top_values(fields).filter("field = 'keywords'").orderBy("rank").collect()
    assert [(r["value"], r["n"], r["percentage"]) for r in top] == [("x", 2, 100.0), ("y", 1, 50.0)]
    role = lambda r: [x["field"] for x in profile.candidates(profile.field_profile(fields), r).collect()]
    assert role("type") == ["Category"] and role("area") == ["Domain"] and role("gist") == ["summary"] and role("tags") == ["keywords"]
    health = profile.profile_health(notes, fields).first()
    assert health["score"] == int(30 * 2 / 3 + 20 + 10 + 15 * 0.5 + 5 + 20 * 0.5 + 0.5) and health["band"] == "good"
    assert {tuple(r) for r in profile.folders(notes).collect()} == {("/", 2), ("f", 1)}
    assert profile.profile_health(notes.limit(0), fields.limit(0)).first()["score"] == 0


def test_migration(spark):
    notes = spark.createDataFrame(NOTES, "path string, content string")
    fields = profile.scan_fields(notes)
    type_, area = profile.recommend(fields, "type"), profile.recommend(fields, "area")
    assert type_.existing == "Category" and type_.mapping == {"Idea Note": "note", "term": "term"} and area.mapping == {"Technology": "tech"}
    assert type_.override(term="project").mapping["term"] == "project"
    assert profile.estimate(profile.value_mapping(fields, "Category", profile.RECOMMENDED["type"])).first()["n"] == 1
    maps = fields.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("field", F.get("values", F.lit(0))))).alias("fields"))
    plan = profile.migration_plan(notes.join(maps, "path", "left"), type_, area)
    changes = {(r["path"], c["field"], c["action"], c["new_value"]) for r in plan.collect() for c in r["changes"]}
    assert changes == {("a.md", "note_type", "update", "note"), ("b.md", "note_area", "update", "tech"), ("f/c.md", "note_type", "add", "note")}
    new = {r["path"]: r["new_content"] for r in profile.apply_migration(notes, plan).collect()}
    assert new["f/c.md"] == "---\nnote_type: note\n---\nno frontmatter"
    assert new["a.md"] == NOTES[0][1].replace("rank: 3.5", "rank: 3.5\nnote_type: note") and new["b.md"].endswith("keywords: [x]\nnote_area: tech\n---\nB")
    same = spark.createDataFrame([("d.md", "---\nnote_type: odd\n---\nD")], "path string, content string")
    rec = profile.Recommendation("note_type", ("note",), {"odd": "note"}, True)
    plan = profile.migration_plan(same.withColumn("fields", F.create_map(F.lit("note_type"), F.lit("odd"))), rec, profile.Recommendation(None, (), {}, False))
    assert profile.apply_migration(same, plan).first()["new_content"] == "---\nnote_type: note\n---\nD"


def test_clean_fields_are_kept(spark):
    notes = spark.createDataFrame([("a.md", "---\nnote_type: own\n---\n")], "path string, content string")
    rec = profile.recommend(profile.scan_fields(notes), "type")
    assert not rec.needs_migration and rec.values == ("own",)
    assert profile.recommend(profile.scan_fields(notes), "area").existing is None


T0 = datetime(2024, 5, 1)
EVENTS = [("a.md", None, "create", 0), ("a.md", None, "modify", 0.4), ("b.md", "a.md", "rename", 0.9), ("c.txt", None, "create", 1), (".x/c.md", None, "create", 1), ("c.md", None, "modify", 5), ("b.md", None, "delete", 9), ("z.md", None, "create", 60)]


def feed(spark):
    rows = [(p, o, k, T0 + timedelta(seconds=s)) for p, o, k, s in EVENTS]
    return spark.createDataFrame(rows, watch.CHANGES)


def test_batch_feed(spark):
    rows = watch.expand_renames(watch.notes_only(feed(spark)))
    assert rows.count() == 7
    last = {(r["path"], r["ts"].second): (r["kind"], r["n"]) for r in watch.last_events(rows).collect()}
    assert last["a.md", 0] == ("delete", 3) and last["b.md", 0] == ("create", 1) and last["b.md", 9] == ("delete", 1)
    assert sorted(r["n"] for r in watch.debounce(rows).collect()) == [1, 1, 1, 4]
    assert watch.debounce(rows, per_path=True).count() == 5


def write(spark, folder):
    for i, (p, o, k, s) in enumerate(EVENTS):
        line = {"path": p, "old_path": o, "kind": k, "ts": (T0 + timedelta(seconds=s)).isoformat()}
        (folder / f"{i:03}.json").write_text(json.dumps(line) + "\n")


def test_streaming_sessions(spark, tmp_path):
    write(spark, tmp_path)
    rows = watch.expand_renames(watch.notes_only(watch.read_changes(spark, str(tmp_path))))
    q = watch.last_events(rows, late="0 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / ".cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["path"], r["kind"]) for r in spark.sql("SELECT * FROM bursts").collect()}
    assert {("a.md", "delete"), ("b.md", "create"), ("c.md", "modify"), ("b.md", "delete")} <= got and ("z.md", "create") not in got


def test_streaming_upserts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(spark, tmp_path / "in")
    state: set[str] = set()

    def apply(upserts, deletes):
        state.difference_update(r["path"] for r in deletes.collect())
        state.update(r["path"] for r in upserts.collect())

    watch.run(watch.read_changes(spark, str(tmp_path / "in")), apply, str(tmp_path / "cp"), gap=None).awaitTermination()
    assert state == {"c.md", "z.md"}


def test_streaming_applies_ended_bursts(spark, tmp_path):
    """With a gap only bursts that are over are applied; those that may go on wait."""
    (tmp_path / "in").mkdir()
    write(spark, tmp_path / "in")
    applied: list[tuple[str, str]] = []

    def apply(upserts, deletes):
        applied.extend((r["path"], "upsert") for r in upserts.collect())
        applied.extend((r["path"], "delete") for r in deletes.collect())

    watch.run(watch.read_changes(spark, str(tmp_path / "in")), apply, str(tmp_path / "cp"), gap="2 seconds", late="0 seconds").awaitTermination()
    assert {("c.md", "upsert"), ("a.md", "delete"), ("b.md", "delete")} <= set(applied) and ("z.md", "upsert") not in applied


def test_catch_up(spark):
    files = spark.createDataFrame([("a", 1, "x"), ("b", 2, "new"), ("d", 1, "y")], "path string, mtime int, text string")
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 1, "old"), ("c", 1, "z")], "path string, mtime int, text string")
    got: list[set[str]] = []
    apply = lambda *sets: got.extend({r["path"] for r in s.collect()} for s in sets)
    assert watch.catch_up(files, stored, apply) == {"unchanged": 1, "updated": 1, "added": 1, "removed": 1}
    assert got == [{"b", "d"}, {"c"}]
    assert watch.catch_up(files, files, apply) == {"unchanged": 3} and len(got) == 2


def test_fields_of_many_values(spark):
    """All values are mapped, though there are more than anyone would list; overrides go first."""
    notes = spark.createDataFrame([(f"{i}.md", f"---\nkind: Value {i} project\n---\n") for i in range(1500)] + [("t.md", "---\nkind: a term\nsummary: s\nkeywords: [x]\n---\n"), ("n.md", "none")], "path string, content string")
    fields = profile.scan_fields(notes)
    rec = profile.recommend(fields, "type")
    assert rec.existing == "kind" and rec.needs_migration and rec.mapping == {}
    held = notes.join(fields.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("field", F.get("values", F.lit(0))))).alias("fields")), "path", "left")
    plan = profile.migration_plan(held, rec.override(**{"Value 7 project": "log"}), profile.Recommendation(None, (), {}, False))
    new = Counter(c["new_value"] for r in plan.collect() for c in r["changes"] if c["action"] == "update")
    assert new == {"project": 1499, "log": 1, "term": 1}
    schema = profile.recommend_schema(notes, fields)
    assert (schema.gist, schema.tags, schema.notes_without_gist, schema.type_updates, schema.area_updates, schema.new_frontmatter) == ("summary", "keywords", 1500, 1501, 0, 1)
    bare = profile.recommend_schema(notes.limit(0), fields.limit(0))
    assert (bare.gist, bare.tags, bare.notes_without_gist, bare.type_updates) == (None, None, 0, 0)


def test_corpus_round_trip(spark):
    docs = spark.createDataFrame([(i, f"Firsty lineup WORD{i}\nmore", ("en", "fr", "xx")[i % 3], "s", 9) for i in range(12)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    notes = src.corpus(docs)
    back = src.parse_notes(src.rendered(notes).select("path", "name", "content", "modified"))
    key = lambda df: sorted((r["path"], r["type"], r["status"], r["area"], r["gist"], tuple(r["tags"])) for r in df.select("path", *[F.coalesce(F.col(c), F.lit("-")).alias(c) for c in ("type", "status", "area", "gist")], "tags").collect())
    assert key(notes) == key(back)


def test_suggesting_from_pages_of_tags_that_share_a_name(spark, monkeypatch):
    monkeypatch.setattr(tags, "TAGS", 2)
    catalogue = spark.createDataFrame([("db", ["data base"], [1.0, 0.0]), ("db", ["postgres"], None), ("db", ["sqlite"], None), ("db", ["sqlite"], None), (None, ["x"], None), ("web", [], [0.0, 1.0]), ("zoo", None, [1.0])], "name string, aliases array<string>, vec array<double>")
    texts = spark.createDataFrame([(1, "on SQLITE", [0.0, 2.0]), (2, "postgres", None), (3, None, [1.0, 0.0, 0.0]), (4, "nothing", [1.0, 0.0])], "doc_id bigint, text string, vec array<double>")
    got = sorted((r["doc_id"], r["tag"], r["score"], r["reason"]) for r in tags.suggest(texts, catalogue).collect())
    assert got == [(1, "db", 0.95, "alias:sqlite"), (1, "web", 1.0, "semantic"), (2, "db", 0.95, "alias:postgres"), (4, "db", 1.0, "semantic")]
