"""Sources of notes: a folder of markdown files, an exported index, an inbox, and the driver's tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

FILES = "path string, name string, content string, modified timestamp, created timestamp"
INDEX = "path string, gist string, mtime bigint, indexed boolean, fields map<string,string>, tags array<string>"
META = "embeddingMode string, dimension int, noteCount int, indexSize int, exportedAt bigint, version int"


def list_notes(root: str) -> list[str]:
    """The relative paths of the ``.md`` files under a folder. Spark's own lister hides names with ``_``; here only
    components that start with ``.`` are left out."""
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(x for x in folders if not x.startswith("."))
        found += [os.path.relpath(os.path.join(folder, x), root) for x in names if x.endswith(".md") and not x.startswith(".")]
    return sorted(found)


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, content, modified, created) of the notes under a folder that all executors share. Files that can't
    be read or aren't UTF-8 are left out. Sort by name and path for the order of a listing."""
    root = os.path.abspath(root)
    paths = list_notes(root)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rel in batch["path"]:
                try:
                    p = Path(root, rel)
                    stat, content = p.stat(), p.read_bytes().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    continue
                at = [datetime.fromtimestamp(x, timezone.utc) for x in (stat.st_mtime, getattr(stat, "st_birthtime", stat.st_mtime))]
                rows.append((rel, p.stem, content, *at))
            yield pd.DataFrame(rows, columns=["path", "name", "content", "modified", "created"])

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism))).mapInPandas(load, FILES)


def parse_notes(files: DataFrame, prefix: str = "note_", strict_values: bool = True) -> DataFrame:
    """The typed columns of notes: their raw frontmatter, fields, type, status, area, gist, tags and sources."""
    raw = tx.frontmatter(F.col("content"))
    out = tx.once(tx.once(files, raw=raw), fields=F.when(F.col("raw").isNotNull(), tx.fields(F.col("raw"), prefix, strict_values)))
    plain = lambda k: F.when(tx.unquote(F.col("fields")[k]) != "", tx.unquote(F.col("fields")[k]))
    return out.select(
        "*", plain("type").alias("type"), plain("status").alias("status"), plain("area").alias("area"), tx.gist(F.col("raw"), prefix).alias("gist"),
        F.coalesce(tx.list_value(F.col("fields")["tags"]), F.array().cast("array<string>")).alias("tags"), tx.list_value(F.col("fields")["source"]).alias("source"),
    )


def note_names(notes: DataFrame) -> DataFrame:
    return notes.select("name").distinct()


def links(notes: DataFrame) -> DataFrame:
    """(src, dst, pos) of all wikilinks, repeats kept."""
    return notes.select(F.col("name").alias("src"), F.posexplode(tx.wikilinks(F.col("content"))).alias("pos", "dst")).select("src", "dst", "pos")


def coerce_fields(raw: Column) -> Column:
    """A JSON object of any values as a map of strings: numbers and booleans as text, arrays joined by ``, `` without
    empty items, objects and nulls dropped."""
    pairs = F.from_json(raw, "map<string,string>")
    items = lambda v: F.filter(F.from_json(v, "array<string>"), lambda x: x.isNotNull() & (x != ""))
    flat = F.transform_values(pairs, lambda k, v: F.when(F.startswith(v, F.lit("[")), F.array_join(items(v), ", ")).otherwise(v))
    return F.map_filter(flat, lambda k, v: v.isNotNull() & ~F.startswith(v, F.lit("{")))


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(notes, meta) of an exported index, with lenient field values: its notes are one file with
    a JSON array, or a folder of files with JSON lines."""
    reader = spark.read.schema("path string, gist string, mtime bigint, indexed boolean, fields string, tags array<string>")
    path = f"{folder}/notes.json"
    raw = reader.json(path) if Path(path).is_dir() else reader.json(path, multiLine=True)
    return raw.withColumn("fields", coerce_fields(F.col("fields"))), spark.read.schema(META).json(f"{folder}/meta.json", multiLine=True)


def index_exists(folder: str) -> bool:
    return all(Path(folder, x).exists() for x in ("notes.json", "meta.json", "vectors"))


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """(content, bytes, lines) of an inbox file, one row; an empty one if there is no file."""
    if not Path(path).exists():
        return spark.createDataFrame([("", 0, 0)], "content string, bytes int, lines int")
    whole = spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")
    return whole.select("content", F.octet_length("content").alias("bytes"), line_count(F.col("content")).alias("lines"))


def line_count(content: Column) -> Column:
    """Lines as an iterator over them counts: a line end at the end starts no other."""
    return F.when(F.coalesce(content, F.lit("")) == "", 0).otherwise(F.size(F.split(content, "\n")) - F.endswith(content, F.lit("\n")).cast("int"))


def memos(content: Column) -> Column:
    """The memos of an inbox: its parts between lines of ``---``, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(content, r"(?m)^---\r?$"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def sample_files(files: DataFrame, most: int = 200, seed: int = 42) -> DataFrame:
    """At most ``most`` files at random, alike for a seed."""
    return files.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(most)


# The driver's tables as notes ------------------------------------------------------------------------------------------

TYPES_IN_TURN = ("note", "term", "project", "log", "lesson", "memo", "note")
STATUSES_IN_TURN = ("active", "done", "archived", "draft")
AREA_OF_LANG = {"en": "tech", "fr": "life", "de": "work", "es": "Misc"}


def corpus(documents: DataFrame) -> DataFrame:
    """Documents as notes: names, paths, fields, tags and links follow from the columns. Some types, statuses and areas
    are missing or invalid, some notes have no gist, and some links lead nowhere, so that audits find something."""
    i = F.col("doc_id")
    turn = lambda values, n: F.get(F.array(F.lit(None).cast("string"), *map(F.lit, values)), (i % n).cast("int"))
    name = F.concat(F.lit("doc-"), i.cast("string"))
    first = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1)
    area = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in AREA_OF_LANG.items()])
    links_ = F.concat(F.lit("\n[[doc-"), (i * 7 % (i + 3)).cast("string"), F.lit("]] [[ghost-"), (i % 10).cast("string"), F.lit("|ghost]]"))
    return documents.select(
        "doc_id", F.concat(F.lit("Notes/"), F.col("source"), F.lit("/"), name, F.lit(".md")).alias("path"), name.alias("name"),
        turn(TYPES_IN_TURN, 8).alias("type"), turn(STATUSES_IN_TURN, 5).alias("status"), area.alias("area"), F.when(i % 7 != 0, first).alias("gist"),
        F.slice(F.array_distinct(F.regexp_extract_all(first, F.lit("[A-Za-z]{5,}"), 0)), 1, 6).alias("tags"), F.concat(F.coalesce("text", F.lit("")), links_).alias("body"),
        F.timestamp_add("DAY", (i % 400).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("modified"), F.date_add(F.lit("2024-06-01").cast("date"), (i % 50).cast("int")).alias("gist_date"),
    )


def rendered(notes: DataFrame, prefix: str = "note_") -> DataFrame:
    """Corpus rows with their markdown in ``content``: frontmatter and body."""
    front = tx.render_frontmatter(prefix, F.col("type"), F.col("area"), F.col("gist"), F.col("tags"), F.array().cast("array<string>"), F.col("gist_date"), F.col("status"))
    return notes.withColumn("content", F.concat(front, F.lit("\n\n"), F.col("body")))
