"""Reading, parsing, auditing, listing and saving notes."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marginalia.config import NotesConfig
from marginalia.functions import text as tx
from marginalia.operators import audit as au
from marginalia.operators import listing, profile, save, sync
from marginalia.sources import notes as src

ALPHA = "---\nnote_type: note\nnote_status: active\nnote_area: work\nnote_gist: Work note gist for smoke tests.\nnote_tags: [alpha, demo]\n---\n\n# Alpha\n\nLinks to [[beta]].\n"
BETA = '---\nnote_type: term\nnote_status: active\nnote_area: tech\nnote_gist: "Tech term gist for smoke tests."\nnote_tags: [beta]\n---\n\n# Beta\n'
GAMMA = "---\r\nnote_type: project\r\nnote_status: done\r\nnote_area: learning\r\nnote_gist: >\r\n  Learning project\r\n\r\n  gist for smoke tests.\r\n---\r\n# Gamma\r\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("notes")
    for name, content in (("alpha.md", ALPHA), ("beta.md", BETA), ("_sys/gamma.md", GAMMA), (".hidden/x.md", "x"), (".y.md", "x"), ("other.txt", "x")):
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content.encode())
    (root / "bad.md").write_bytes(b"\xff\xfe")
    return str(root)


@pytest.fixture(scope="module")
def notes(spark, folder):
    return src.parse_notes(src.read_folder(spark, folder)).persist()


def test_read_and_parse(notes):
    rows = {r["name"]: r for r in notes.collect()}
    assert sorted(rows) == ["alpha", "beta", "gamma"] and rows["gamma"]["path"] == "_sys/gamma.md"
    assert [rows[n]["gist"] for n in sorted(rows)] == ["Work note gist for smoke tests.", "Tech term gist for smoke tests.", "Learning project gist for smoke tests."]
    assert rows["alpha"]["tags"] == ["alpha", "demo"] and rows["gamma"]["tags"] == [] and rows["gamma"]["area"] == "learning"


def test_status_and_audit(notes):
    assert au.status(notes).first().asDict() == {"total": 3, "with_gist": 3, "with_type": 3, "with_area": 3, "health": 100}
    links = src.links(notes)
    assert {r["name"] for r in au.orphans(links, notes).collect()} == {"alpha", "gamma"}
    checks = {r["check"]: r["status"] for r in au.audit(notes, links).collect()}
    assert checks == {"schema": "warn", "wikilinks": "pass", "gist": "pass", "tags": "fail", "orphans": "fail", "stale_gists": "pass"}
    assert au.audit(notes, links, quick=True).count() == 2
    totals = au.audit_totals(au.audit(notes, links)).first()
    assert (totals["passed"], totals["failed"]) == (3, 2)
    assert au.audit(notes.limit(0), links.limit(0)).filter("status <> 'pass'").count() == 0


def parsed(spark, *contents):
    rows = [(f"n{i}.md", f"n{i}", c, datetime(2024, 6, 1)) for i, c in enumerate(contents)]
    return src.parse_notes(spark.createDataFrame(rows, "path string, name string, content string, modified timestamp"))


def test_violations(spark):
    good = "---\nnote_type: note\nnote_status: active\nnote_area: work\nnote_gist: g\n{}---\n"
    notes = parsed(
        spark, "no frontmatter", good.format("note_tags: [a/b, Upper, c, d, e, f]\n"), "---\nnote_type: odd\nnote_area: 'moon'\n---\n", good.format("") + "\n---\nnote_type: x\n---\n", good.format("bad: [1, 2\n"), good.format("note_note: >-\n")
    )
    got = {(r["name"], r["code"], r["arg"]) for r in au.violations(notes, yaml=True).collect() if r["code"] != "yaml_syntax"}
    expected = {("n0", "missing_frontmatter", ""), ("n1", "hierarchical_tag", "a/b"), ("n1", "non_lowercase_tag", "Upper"), ("n1", "too_many_tags", "6"), ("n2", "invalid_type", "odd"), ("n2", "invalid_area", "moon")}
    expected |= {("n2", "missing_field", "note_status"), ("n2", "missing_field", "note_gist"), ("n3", "duplicate_frontmatter", "2"), ("n5", "folded_scalar", "note")}
    assert got == expected
    yaml = au.violations(notes, yaml=True).filter("code = 'yaml_syntax'").collect()
    assert [r["name"] for r in yaml] == ["n4"] and "line" in yaml[0]["message"]
    loose = NotesConfig(required_fields=(), hierarchical_tags=True, lowercase_tags=False, max_tags=9)
    assert {r["code"] for r in au.violations(notes, loose).collect()} == {"missing_frontmatter", "duplicate_frontmatter", "folded_scalar"}
    by_code = {r["code"]: r for r in au.violations(notes).collect()}
    assert by_code["invalid_type"]["message"] == "type 'odd' is none of note, term, project, log, lesson" and by_code["folded_scalar"]["severity"] == "warning"


def test_frontmatter_values(spark):
    n = parsed(spark, "---\nnote_a:\nnote_b: x\nnote_b: 'y'\n---\nbody", "---\n---\nbody", "---\nnote_gist: |\n  one\n\n  two\nnote_x: 1\n---")
    rows = n.orderBy("name").collect()
    assert rows[0]["fields"] == {"a": "", "b": "'y'"} and rows[1]["raw"] is None and rows[2]["gist"] == "one two"
    lax = src.parse_notes(n.select("path", "name", "content", "modified"), strict_values=False).orderBy("name").first()
    assert lax["fields"]["a"] == "note_b: x"
    assert n.orderBy("name").select(tx.body(F.col("content"))).first()[0] == "body"


LINES, HEAD = 100_000, "---\nnote_type: note\nnote_gist: g\n---\n"


@pytest.mark.parametrize(
    "content, gist, n_fields, n_links",
    [
        ("---\nnote_gist: >\n" + "  word\n" * LINES + "note_type: note\n---\n[[x]]", 5 * LINES - 1, 2, 1),
        ("---\n" + "".join(f"note_k{i}: v\n" for i in range(LINES)) + "note_type: note\n---\n[[x]]", None, LINES + 1, 1),
        ("---\n" + "note_k: v\n" * LINES + "note_type: note\n---\n[[x]]", None, 2, 1),
        ("---\nnote_gist: " + "x" * 10_000_000 + "\nnote_type: note\n---\n[[x]]", 10_000_000, 2, 1),
        (HEAD + "word [[x]]\n" * 900_000, 1, 2, 900_000),
        (HEAD + "[[" * 5_000_000, 1, 2, 0),
        (HEAD + "[[a|" * 1_000_000 + "b]]", 1, 2, 1),
    ],
    ids=["block", "fields", "repeats", "line", "body", "open", "labels"],
)
def test_long_notes(spark, content, gist, n_fields, n_links):
    """Long notes are parsed in linear time and without recursion."""
    files = spark.createDataFrame([("a.md", "a", content, datetime(2024, 6, 1))], "path string, name string, content string, modified timestamp")
    row = src.parse_notes(files).select("type", F.char_length("gist").alias("gist"), F.size("fields").alias("n")).first()
    assert tuple(row) == ("note", gist, n_fields)
    assert profile.scan_fields(files).count() == n_fields and src.links(files).count() == n_links
    row = files.select(F.char_length(tx.body(F.col("content"))).alias("b"), tx.block_count(F.col("content")).alias("n"), tx.completion_prefix(F.col("content")).alias("c")).first()
    assert row["b"] == len(content.split("\n---\n", 1)[1]) and row["n"] == 1 and (row["c"] is None) == ("]" in content)


@pytest.mark.parametrize("text, found", [("see [[", None), ("see [[a", None), ("see [[ab", "ab"), ("[[x]] [[ab [[c\n", "ab [[c"), ("[[ab]", None), ("no", None), (None, None)])
def test_completion_prefix(spark, text, found):
    assert spark.createDataFrame([(text,)], "t string").select(tx.completion_prefix(F.col("t"))).first()[0] == found


def test_links_and_titles(spark):
    df = spark.createDataFrame([("[[a]] ![[b|c]] [[ d ]] [[]] [[e#h]]", "x/y/My-note_1.md.md")], "content string, path string")
    row = df.select(tx.wikilinks(F.col("content")).alias("l"), tx.title_from_path(F.col("path")).alias("t"), tx.filename_text(F.col("path")).alias("f"), tx.hidden(F.col("path")).alias("h"), tx.ellipsis(F.col("path"), 5).alias("e"), tx.percent(F.lit(0.256)).alias("p")).first()
    assert row["l"] == ["a", "b", "d", "e#h"] and row["t"] == "My-note_1" and row["f"] == "My note 1.md" and not row["h"] and row["e"] == "x/y/M..." and row["p"] == "26%"


def test_link_report(spark):
    links = spark.createDataFrame([("a", "b", 0), ("a", "b", 1), ("b", "zz", 0), ("c", "c", 0)], "src string, dst string, pos int")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert au.link_report(links, names).first().asDict() == {"total": 4, "valid": 3, "broken": 1, "files_with_broken": 1, "orphans": 1}
    assert {tuple(r) for r in au.incoming(links, names).collect()} == {("a", 0), ("b", 2), ("c", 1)}


def test_listing(notes):
    assert [r["title"] for r in listing.list_notes(notes, limit=2).collect()] == ["alpha", "beta"]
    assert listing.get_note(notes, "_sys").first()["name"] == "gamma" and listing.get_note(notes, "nope").count() == 0
    assert listing.project(notes, "all").columns == ["title", "path", "gist", "type", "status", "area", "tags", "source", "modified", "created"]
    assert listing.resolve_fields("Type, nope ,GIST") == ["type", "gist"] and listing.resolve_fields(None) == ["title", "path", "gist"]
    assert "area" not in listing.as_json(notes.withColumn("area", F.lit(None).cast("string")), "area").first()["json"]
    assert listing.list_notes(notes, type="term", area="tech").count() == 1
    kept = notes.select(listing.pick_fields(F.col("fields"), ["type"]).alias("f")).first()["f"]
    assert list(kept) == ["type"]


def test_config(tmp_path):
    raw = {"schema": {"typeValues": ["x"], "areaValues": ["y"]}, "tags": {"maxCount": 2}, "version": 2, "unknown": 1, "folders": {"notes": "N"}}
    c = NotesConfig.from_dict(raw)
    assert (c.types, c.areas, c.max_tags, c.version, c.folders["notes"], c.folders["archive"]) == (("x",), ("y",), 2, 4, "N", "Archive")
    c.save(tmp_path / "c.json")
    (tmp_path / "broken.json").write_text("{")
    assert NotesConfig.load(tmp_path / "none", tmp_path / "broken.json", tmp_path / "c.json") == c and NotesConfig.load() == NotesConfig()
    assert NotesConfig(required_fields=("note_type",)).requires("type") and not NotesConfig(required_fields=()).requires("type")
    assert NotesConfig().with_values(types=["a"]).types == ("a",)


REQUEST = "title string, content string, type string, area string, gist string, tags array<string>, source array<string>, today date"


def test_save(spark, notes, tmp_path):
    requests = spark.createDataFrame([(t, "text", "note", None, "g", ["a", "b"], None, date(2024, 5, 1)) for t in ("alpha", "new", "new", "../evil", " ")], REQUEST)
    made = save.create(requests, notes).collect()
    assert sorted((r["title"], r["outcome"]) for r in made) == [(" ", "invalid"), ("../evil", "invalid"), ("alpha", "exists"), ("new", "created"), ("new", "exists")]
    assert made[0]["content"] == "---\nnote_type: note\nnote_status: active\nnote_gist: >\n  g\nnote_gist_source: ai\nnote_gist_date: 2024-05-01\nnote_tags: [a, b]\n---\n\ntext\n"
    changed = {r["name"]: r["content"] for r in save.update(requests, notes).collect()}
    assert changed["alpha"] == made[0]["content"] and changed["beta"] == BETA
    added = {r["name"]: r["content"] for r in save.append(requests, notes).collect()}
    assert added["alpha"] == ALPHA.rstrip() + "\n\ntext" and added["beta"] == BETA
    files = spark.createDataFrame([("a/b.md", "x"), ("../out.md", "y")], "path string, content string")
    errors = {r["path"]: r["error"] for r in save.write_files(files, str(tmp_path)).collect()}
    assert errors["a/b.md"] is None and errors["../out.md"] and (tmp_path / "a/b.md").read_text() == "x" and not (tmp_path.parent / "out.md").exists()


def test_smart_save(notes):
    from marginalia.functions.vectors import embed

    index = notes.withColumn("vec", embed(F.col("gist")))
    decision, close = save.smart("x", "Work note gist for smoke tests", index)
    assert decision == "needs_decision" and close.first()["name"] == "alpha"
    assert save.smart("quantum zebra", None, index, least=0.95)[0] == "create"


def test_inbox(spark, tmp_path):
    path = str(tmp_path / "deep/inbox.md")
    assert src.read_inbox(spark, path).first()["bytes"] == 0
    save.append_inbox(path, "one", at=datetime(2024, 5, 1, 8, 5))
    save.append_inbox(path, "zwei ü", "Title", datetime(2024, 5, 2, 9, 0))
    row = src.read_inbox(spark, path).withColumn("memos", src.memos(F.col("content"))).first()
    assert row["memos"] == ["# Inbox", "**2024-05-01 08:05**\n\none", "**2024-05-02 09:00** - Title\n\nzwei ü"] and row["bytes"] == len(row["content"].encode()) and row["lines"] == 12
    assert src.memos is not None and row["content"].count("\n---\n") == 2
    save.clear_inbox(path)
    assert src.read_inbox(spark, path).count() <= 1
    save.quick_capture(path, "a")
    save.quick_capture(path, "b")
    assert open(path).read() == "a\n---\n\nb"


def test_sync(spark):
    files = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, None), ("d", 4, "z")], "path string, mtime int, text string")
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 3, None), ("e", 1, "e")], "path string, mtime int, text string")
    diff = sync.diff(files, stored)
    assert {tuple(r) for r in diff.collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "unchanged"), ("d", "added"), ("e", "removed")}
    assert sorted(map(tuple, sync.apply(stored, files, diff).collect()), key=str) == sorted(map(tuple, files.collect()), key=str)
    assert sync.needs_rebuild(stored, stored.limit(0)) and not sync.needs_rebuild(stored, stored)
    assert save.upsert(stored, files, "path").count() == 5 and save.delete(stored, files, "path").count() == 1


def test_export(spark, notes, tmp_path):
    table = notes.select("path", "gist", F.lit(1).cast("long").alias("mtime"), F.lit(True).alias("indexed"), F.create_map(F.lit("type"), F.col("type")).alias("fields"), "tags")
    assert save.export_index(table, notes.select("path"), str(tmp_path / "index")) and src.index_exists(str(tmp_path / "index"))
    rows, meta = src.read_index(spark, str(tmp_path / "index"))
    assert meta.first()["noteCount"] == 3 and {r["fields"]["type"] for r in rows.collect()} == {"note", "term", "project"}
    assert not save.export_index(table.unionByName(table), notes.select("path"), str(tmp_path / "twice"))
    odd = spark.createDataFrame([('{"n": 1, "b": true, "l": ["x", "", "y"], "o": {"z": 1}, "e": null}',)], "j string")
    assert odd.select(src.coerce_fields(F.col("j"))).first()[0] == {"n": "1", "b": "true", "l": "x, y"}


def test_sampling(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(50)], "path string")
    assert src.sample_files(df, 10).collect() == src.sample_files(df, 10).collect() and src.sample_files(df, 100).count() == 50
