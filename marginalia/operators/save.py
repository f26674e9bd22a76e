"""Saving notes: create, update, append, inbox, and smart saving; keyed upserts and deletes of tables; index export."""

from __future__ import annotations

import json
import time
from datetime import datetime
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import NotesConfig
from ..functions import text as tx
from ..functions.vectors import Embedder
from .knn import knn

SIMILAR, CLOSEST = 0.7, 3
CONTRACT_VERSION = 1
DIMENSIONS = {"htp": 384, "model2vec": 256}


def safe_title(title: Column) -> Column:
    """Whether a title may be a file name: not empty, no separator, no parent folder, no leading dot."""
    return (F.trim(title) != "") & ~F.regexp_like(title, F.lit(r"[/\\\x00]|^\.|\.\."))


def render(requests: DataFrame, config: NotesConfig, status: str = "active") -> Column:
    """The file content of requests (title, content, type, area, gist, tags, source, today)."""
    front = tx.render_frontmatter(config.field_prefix, F.col("type"), F.col("area"), F.col("gist"), F.col("tags"), F.col("source"), F.col("today"), F.lit(status))
    return F.concat(front, F.lit("\n\n"), F.col("content"), F.lit("\n"))


def create(requests: DataFrame, notes: DataFrame, config: NotesConfig | None = None) -> DataFrame:
    """(title, path, content, outcome): created, or exists, or invalid. A title may stand once in a batch."""
    c = config or NotesConfig()
    taken = notes.select(F.col("name").alias("title"), F.lit(True).alias("taken")).distinct()
    rows = requests.withColumn("new", render(requests, c)).join(taken, "title", "left")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("title").orderBy("new")))
    outcome = F.when(~safe_title(F.col("title")), "invalid").when(F.col("taken") | (F.col("nth") > 1), "exists").otherwise("created")
    path = F.concat(F.lit(c.folders["notes"] + "/"), F.col("title"), F.lit(".md"))
    return rows.select("title", path.alias("path"), F.col("new").alias("content"), outcome.alias("outcome"))


def update(requests: DataFrame, notes: DataFrame, config: NotesConfig | None = None) -> DataFrame:
    """``notes`` (path, name, content) with the content of requested names replaced whole: the status starts anew."""
    c = config or NotesConfig()
    new = requests.select(F.col("title").alias("name"), render(requests, c).alias("_new")).dropDuplicates(["name"])
    return notes.join(new, "name", "left").withColumn("content", F.coalesce("_new", "content")).select(*notes.columns)


def append(requests: DataFrame, notes: DataFrame) -> DataFrame:
    """``notes`` with the requested contents added after an empty line; those of one note in the order of their text."""
    more = requests.groupBy(F.col("title").alias("name")).agg(F.array_join(F.array_sort(F.collect_list("content")), "\n\n").alias("_more"))
    joined = F.concat(F.regexp_replace("content", r"\s+$", ""), F.lit("\n\n"), F.col("_more"))
    return notes.join(more, "name", "left").withColumn("content", F.when(F.col("_more").isNotNull(), joined).otherwise(F.col("content"))).select(*notes.columns)


def inbox_entry(content: Column, title: Column, at: Column) -> Column:
    """A memo as the inbox has it: a rule, the time and the title, and the text."""
    named = F.when((F.trim(F.coalesce(title, F.lit(""))) != "") & (F.lower(F.trim(title)) != "inbox"), F.concat(F.lit(" - "), title)).otherwise("")
    return F.concat(F.lit("\n---\n\n**"), F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit("**"), named, F.lit("\n\n"), content)


def append_inbox(path: str, content: str, title: str | None = None, at: datetime | None = None) -> None:
    """Adds one memo to an inbox file; a new one gets a heading first."""
    bootstrap_inbox(path)
    named = f" - {title}" if title and title.strip() and title.strip().lower() != "inbox" else ""
    with open(path, "a", encoding="utf-8") as out:
        out.write(f"\n---\n\n**{(at or datetime.now()):%Y-%m-%d %H:%M}**{named}\n\n{content}")


def quick_capture(path: str, content: str) -> None:
    """Adds a memo without a time; a new file starts with it."""
    p = Path(path)
    old = p.read_text(encoding="utf-8") if p.exists() else ""
    p.write_text(f"{old}\n---\n\n{content}" if old else content, encoding="utf-8")


def bootstrap_inbox(path: str, template: str = "# Inbox\n") -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    if not p.exists():
        p.write_text(template, encoding="utf-8")


def clear_inbox(path: str) -> None:
    """Empties an inbox and keeps the file."""
    if Path(path).exists():
        Path(path).write_text("", encoding="utf-8")


def smart(title: str, gist: str | None, index: DataFrame, embedder: Embedder | None = None, least: float = SIMILAR, key: str = "path") -> tuple[str, DataFrame]:
    """(needs_decision or create, the most similar notes): what to do with a note whose gist, or title, is given."""
    query = (embedder or Embedder()).query(gist or title)
    close = knn(index, "vec", query, CLOSEST, key).filter(F.col("score") >= least)
    return ("create" if close.isEmpty() else "needs_decision"), close


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Writes (path, content) below a folder that all executors share; (path, error) of each."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            errors = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    target = Path(root, path)
                    if not target.resolve().is_relative_to(Path(root).resolve()):
                        raise ValueError("outside the folder")
                    target.parent.mkdir(parents=True, exist_ok=True)
                    target.write_text(content, encoding="utf-8")
                    errors.append(None)
                except (OSError, ValueError) as e:
                    errors.append(str(e))
            yield pd.DataFrame({"path": batch["path"], "error": errors})

    return rows.select("path", "content").mapInPandas(run, "path string, error string")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables (name: rows and the column that refers to the key) without the rows of these keys. Keys that are null, and rows
    without one, delete nothing."""
    gone = keys.select(F.col(key).alias("_gone")).filter("_gone is not null").distinct()
    return {name: rows.join(gone, F.col(of) == F.col("_gone"), "left_anti") for name, (rows, of) in tables.items()}


def increment_usage(tags: DataFrame, uses: DataFrame) -> DataFrame:
    """``tags`` (name, usage_count, ..) with the uses (name) counted in."""
    counts = uses.groupBy("name").agg(F.count("*").alias("_n"))
    return tags.join(counts, "name", "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("_n", F.lit(0))).select(*tags.columns)


def contract_errors(notes: DataFrame, meta: dict) -> DataFrame:
    """(code, path, n) of what breaks the index contract: the version, the counts, the dimension, empty, null and repeated
    paths, and missing gists. No row: it may be exported."""
    spark = notes.sparkSession
    counts = notes.agg(F.count("*").alias("n"))
    checks = [("version", meta.get("version") != CONTRACT_VERSION), ("dimension", meta.get("dimension") != DIMENSIONS.get(meta.get("embeddingMode")))]
    fixed = spark.createDataFrame([(code, None, 1) for code, bad in checks if bad], "code string, path string, n bigint")
    sized = counts.filter((F.col("n") != F.lit(meta.get("noteCount"))) | (F.col("n") == 0)).select(F.lit("note_count").alias("code"), F.lit(None).cast("string").alias("path"), "n")
    empty = notes.filter("path is null or path = ''").groupBy("path").agg(F.count("*").alias("n")).select(F.lit("missing_path").alias("code"), "path", "n")
    twice = notes.filter("path <> ''").groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated_path").alias("code"), "path", "n")
    no_gist = notes.filter("gist is null").select(F.lit("missing_gist").alias("code"), "path", F.lit(1).cast("long").alias("n"))
    return fixed.unionByName(sized).unionByName(empty).unionByName(twice).unionByName(no_gist)


def export_index(notes: DataFrame, vectors: DataFrame, folder: str, mode: str = "htp") -> bool:
    """Writes notes, vectors and meta below a folder, if the notes keep the contract. Notes are a folder notes.json of JSON
    lines, as many files as there are partitions; vectors are parquet."""
    count = notes.count()
    meta = {"embeddingMode": mode, "dimension": DIMENSIONS[mode], "noteCount": count, "indexSize": vectors.count(), "exportedAt": int(time.time() * 1000), "version": CONTRACT_VERSION}
    if not contract_errors(notes, meta).isEmpty():
        return False
    notes.write.mode("overwrite").json(f"{folder}/notes.json")
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    notes.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta.json")
    return True


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def restore_index(spark: SparkSession, folder: str) -> DataFrame | None:
    """The vectors of an exported index; None if there are none. One that is there but can't be read, or has no vector
    although its meta counts some, is damaged: its vectors are removed, so that the next sync builds them anew."""
    path = f"{folder}/vectors"
    if not exists(spark, path):
        return None
    try:
        vectors = spark.read.parquet(path)
        stored = spark.read.json(f"{folder}/meta.json").first() if exists(spark, f"{folder}/meta.json") else None
        if not vectors.isEmpty() or (stored and stored["indexSize"] == 0):
            return vectors
    except (AnalysisException, Py4JJavaError) as e:
        if isinstance(e, Py4JJavaError) and "is not a Parquet file" not in str(e):
            raise  # what keeps Spark from reading may pass; only what the files say is damage
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return None
