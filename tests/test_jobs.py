"""The jobs on copies of small inputs that grow."""

import json
import os
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from jobs import audit_report, index_upkeep
from jobs.common import read_config

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, stamp int, deleted boolean"
CONFIG = {"order": "stamp", "gone": "deleted", "segments": 4}


def more(spark, folder, rows):
    """A new file of the source."""
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(folder))


def doc(i, text, stamp=0, deleted=False):
    return i, text, "en", "s", len(text or ""), stamp, deleted


def postings(index):
    return {(r["doc_id"], r["field"], r["term"]): (r["tf"], r["dl"]) for r in index.postings().collect()}


def expected(texts):
    out = {}
    for i, text in texts.items():
        for name, value in (("title", f"doc-{i}"), ("body", text or "")):
            terms = [t for t in re.split(r"[\W_]+", value.lower()) if t]
            out |= {(i, name, t): (n, len(terms)) for t, n in Counter(terms).items()}
    return out


def test_index_upkeep_takes_what_is_new(spark, tmp_path):
    source, run = tmp_path / "docs", lambda: index_upkeep.run(spark, str(tmp_path / "docs"), str(tmp_path / "index"), str(tmp_path / "mark"), CONFIG)
    held = {i: f"text of note {i}, note by note" for i in range(30)}
    more(spark, source, [doc(i, t) for i, t in held.items()])
    assert postings(run()) == expected(held)
    assert postings(run()) == expected(held) and run().segments() == [0, 1]  # nothing new: nothing is written

    # new notes, a changed one that comes twice, one that goes, one that goes and comes back, and one that comes and goes
    held |= {i: f"later {i}" for i in range(30, 40)} | {3: "changed twice", 5: "back again", 6: None}
    del held[4]
    more(spark, source, [doc(i, held[i]) for i in range(30, 40)] + [doc(3, "changed twice", 2), doc(3, "changed once", 1), doc(4, "x", 1, True), doc(5, "x", 1, True), doc(5, "back again", 2), doc(6, None, 1), doc(41, "never", 1), doc(41, "never", 2, True), doc(7, held[7])])
    index = run()
    assert postings(index) == expected(held) and index.notes == len(held)
    changed = index.docs().filter("segment = 3").collect()
    assert {r["doc_id"] for r in changed} == {*range(30, 40), 3, 5, 6}  # 7 is as it was

    for k in range(2):  # more files: segments are merged
        held[50 + k] = f"file {k}"
        more(spark, source, [doc(50 + k, held[50 + k])])
        index = run()
        assert postings(index) == expected(held)
    assert len(index.segments()) <= CONFIG["segments"] + 1


def test_index_upkeep_after_a_run_that_stopped(spark, tmp_path, monkeypatch):
    source, args = tmp_path / "docs", [str(tmp_path / x) for x in ("docs", "index", "mark")]
    held = {i: f"note {i}" for i in range(10)}
    more(spark, source, [doc(i, t) for i, t in held.items()])
    index_upkeep.run(spark, *args, CONFIG)
    held |= {2: "two", 12: "twelve"}
    more(spark, source, [doc(2, "two", 1), doc(12, "twelve"), doc(1, "", 1, True)])
    del held[1]
    with monkeypatch.context() as m:
        m.setattr(index_upkeep.SegmentedIndex, "remove", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(Exception, match="stopped"):
            index_upkeep.run(spark, *args, CONFIG)
    assert postings(index_upkeep.run(spark, *args, CONFIG)) == expected(held)


def test_index_upkeep_of_a_single_file_and_of_an_empty_table(spark, tmp_path):
    more(spark, tmp_path / "docs", [doc(1, "a b a")])
    [file] = (tmp_path / "docs").glob("*.parquet")
    index = index_upkeep.run(spark, str(file), str(tmp_path / "index"), str(tmp_path / "mark"))
    assert postings(index) == expected({1: "a b a"})
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    assert postings(index_upkeep.run(spark, str(tmp_path / "none"), str(tmp_path / "index2"), str(tmp_path / "mark2"))) == {}


def test_audit_report_replaces_itself(spark, tmp_path):
    source, target = tmp_path / "notes", str(tmp_path / "audit")
    good = "---\nnote_type: note\nnote_status: active\nnote_area: tech\nnote_gist: g\nnote_gist_date: 2024-01-01\n---\n\n"
    rows = [("a.md", "a", good + "[[b]] [[gone]] [[gone]]"), ("b.md", "b", "no frontmatter [[a]]"), ("c.md", "c", good.replace("note_type: note", "note_type: odd") + "[[c]] [[gone|x]]")]
    write = lambda rows: spark.createDataFrame([(*r, "2024-05-05 00:00:00") for r in rows], "path string, name string, content string, modified string").selectExpr("path", "name", "content", "cast(modified as timestamp) as modified").write.mode("overwrite").parquet(str(source))
    write(rows)
    want = {("a", "wikilinks", "broken_link", "gone"): 2, ("c", "wikilinks", "broken_link", "gone"): 1, ("b", "schema", "missing_frontmatter", ""): 1, ("c", "schema", "invalid_type", "odd"): 1, ("a", "stale_gists", "stale_gist", "2024-01-01"): 1, ("c", "stale_gists", "stale_gist", "2024-01-01"): 1}
    told = lambda df: Counter((r["name"], r["check"], r["code"], r["arg"]) for r in df.collect())
    for _ in range(2):
        assert told(audit_report.run(spark, str(source), target)) == want
    assert {p.name for p in Path(target).glob("check=*")} == {"check=schema", "check=wikilinks", "check=stale_gists"}
    write([(*rows[0][:2], good + "[[a]]")])
    assert told(audit_report.run(spark, str(source), target, {"checks": ["schema", "wikilinks", "orphans"]})) == {}
    with pytest.raises(ValueError, match="no checks odd"):
        audit_report.run(spark, str(source), target, {"checks": ["odd"]})


def test_configs(spark, tmp_path):
    for job in (index_upkeep, audit_report):
        given = read_config(spark, str(ROOT / f"{job.__name__.replace('.', '/')}.json"), job.DEFAULTS)
        assert set(given) == set(job.DEFAULTS)
    (tmp_path / "bad.json").write_text(json.dumps({"segmens": 1}))
    with pytest.raises(ValueError, match="segmens"):
        read_config(spark, str(tmp_path / "bad.json"), index_upkeep.DEFAULTS)


def test_command_line(spark, tmp_path):
    more(spark, tmp_path / "docs", [doc(i, f"note {i}") for i in range(5)])
    paths = ["--source", str(tmp_path / "docs"), "--target", str(tmp_path / "index"), "--checkpoint", str(tmp_path / "mark")]
    done = subprocess.run([sys.executable, "-m", "jobs.index_upkeep", *paths, "--config", "jobs/index_upkeep.json"], cwd=ROOT, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 5 new rows" in done.stderr and "has 5 notes" in done.stderr
    assert index_upkeep.index_of(spark, str(tmp_path / "index"), index_upkeep.DEFAULTS).notes == 5


def test_links_and_names_are_audited_without_parsing(spark):
    from jobs.audit_report import findings
    from marginalia.config import NotesConfig

    files = spark.sql("SELECT 'a.md' AS path, 'a' AS name, '---\nnote_type: term\n---\n[[b]] [[a]]' AS content, timestamp '2024-01-01 00:00:00' AS modified FROM range(1)")
    found = findings(files, NotesConfig(), ["wikilinks", "orphans"])
    assert "note_" not in found._jdf.queryExecution().analyzed().toString().replace("note_type: term", "")
    assert [(r["name"], r["code"], r["arg"]) for r in found.collect()] == [("a", "broken_link", "b")]
