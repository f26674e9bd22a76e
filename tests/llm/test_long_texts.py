"""Every operator on texts far longer than a chunk, beside short ones."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import kernels
from marginalia.llm.classifier import classify_quality
from marginalia.llm.decontaminate import decontaminate
from marginalia.llm.language_id import identify_languages
from marginalia.llm.lm_score import lm_scores
from marginalia.llm.mix import mix
from marginalia.llm.near_dedup import near_duplicates
from marginalia.llm.quality_rules import quality_rules
from marginalia.llm.shard import place
from marginalia.llm.substring_dedup import substring_dedup
from marginalia.llm.warc import read_archives, write_archives

from . import corpus

N = 220_000


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    """(rows, tables by name): a text of 1.4 MB, a near copy of it, one word of 3 MB, and short texts."""
    rng = random.Random(31)
    text = corpus.words(rng, N, 10**6)
    rows = [(1, " ".join(text), "en", "a", 0), (2, " ".join(corpus.edited(rng, text, 50)), "en", "b", 0), (3, "x" * 3_000_000, "en", "a", 0)]
    rows += [(10 + i, " ".join(corpus.words(rng, 40)) + ".", "en", "a", 0) for i in range(30)] + [(50, " ".join(["new", *text[-60:]]), "fr", "a", 0)]
    folder = str(tmp_path_factory.mktemp("long"))
    tables = {
        "documents": corpus.frame(spark, rows, extra=False),
        "labels": spark.createDataFrame([(r[0], r[0] % 2, 0) for r in rows], "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(7, " ".join(text[1000:1030]))], "item_id bigint, text string"),
        "pages": spark.createDataFrame([(r[0], f"http://h{r[0]}.test/", f"<p>{r[1]}<!--") for r in rows], "page_id bigint, url string, html string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    assert len(rows[0][1]) > 2 * kernels.CHUNK
    return rows, {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in tables}, folder


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_near_dedup(long):
    got = by_id(near_duplicates(long[1]["documents"]))
    assert got[2]["component_id"] == 1 and not got[2]["kept"] and got[1]["n_shingles"] == N - 4 and got[3]["n_shingles"] == 1


def test_decontaminate(long):
    got = by_id(decontaminate(long[1]["documents"], long[1]["benchmark"]))
    assert got[1]["n_words"] == N and got[1]["n_hit"] == 30 and not got[1]["contaminated"] and got[3]["n_words"] == 1


def test_warc_and_languages(long):
    rows, tables, _ = long
    got = by_id(read_archives(write_archives(tables["pages"])), "page_id")
    assert all(bytes(got[r[0]]["payload"]) == f"<p>{r[1]}<!--".encode() for r in rows)
    assert {r["lang"] for r in identify_languages(tables["pages"], tables["documents"]).collect()} <= {"en", "fr"}


def test_shard_and_mix(long):
    rows, tables, _ = long
    sizes = by_id(mix(tables["documents"]))
    assert sizes[1]["size"] == N and sizes[3]["size"] == 1 and place(tables["documents"]).count() == len(rows)


def test_rules_and_classifier(long):
    _, tables, _ = long
    got = by_id(quality_rules(tables["documents"], tables["labels"]))
    assert got[1]["n_words"] == N and got[1]["n_repeat_words"] == 0 and got[3]["word_chars"] == 3_000_000 and 0 <= got[1]["probability"] <= 1
    assert all(0 <= r["score"] <= 1 for r in classify_quality(tables["documents"], tables["labels"]).collect())


def test_lm(long):
    got = by_id(lm_scores(long[1]["documents"]))
    assert got[1]["n_tokens"] == N + 1 and got[3]["n_tokens"] == 2 and got[1]["score"] < -N


def test_substrings(long):
    rows, tables, _ = long
    got = by_id(substring_dedup(tables["documents"]))
    assert got[1]["n_removed"] == 0 and got[50]["n_removed"] == 60 and got[50]["kept_sha256"] == hashlib.sha256(b"new").hexdigest()
    a, b = rows[0][1].split(), rows[1][1].split()
    same = [x == y for x, y in zip(a, b)]
    gone = {k + j for k in range(N - 12) if all(same[k : k + 13]) for j in range(13)}
    assert got[2]["n_removed"] == len(gone)


def test_pipeline(spark, long):
    _, tables, folder = long
    docs = tables["documents"]
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = {r["doc_id"] for r in stage(spark, docs, folder).select("doc_id").collect()}
        assert 1 in got and (2 in got) == (name != "near-dedup"), name
    assert corpus_pipeline.run(spark, folder).select(F.count("*")).first()[0] >= 0
