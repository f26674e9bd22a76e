"""Change feeds with Structured Streaming: debouncing, the last event of a burst, and keeping a table in step.

A change is (path, kind, ts) with kind create, modify or delete; a rename has old_path too. All functions but ``run`` work
on batch and on streaming DataFrames alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sync

GAP, LATE = "1 second", "10 seconds"
CHANGES = "path string, old_path string, kind string, ts timestamp"


def read_changes(spark: SparkSession, folder: str, schema: str = CHANGES) -> DataFrame:
    """A stream of the change files of a folder."""
    return spark.readStream.schema(schema).json(folder)


def notes_only(changes: DataFrame) -> DataFrame:
    return changes.filter(F.endswith("path", F.lit(".md")) & ~F.exists(F.split("path", "/"), lambda x: F.startswith(x, F.lit("."))))


def expand_renames(changes: DataFrame) -> DataFrame:
    """A rename as a deletion of the old path and a creation of the new one."""
    one = lambda path, kind: F.struct(path.alias("path"), kind.alias("kind"))
    both = F.array(one(F.col("old_path"), F.lit("delete")), one(F.col("path"), F.lit("create")))
    events = F.when(F.col("kind") == "rename", both).otherwise(F.array(one(F.col("path"), F.col("kind"))))
    return changes.select("ts", F.explode(events).alias("e")).select("e.path", "e.kind", "ts")


def debounce(changes: DataFrame, gap: str = GAP, late: str = LATE, per_path: bool = False) -> DataFrame:
    """(start, end, n[, path]): bursts that a quiet gap ends. All paths share one timer, as one session without a key: for
    feeds of many files take ``per_path``, which spreads the state over the paths."""
    window = F.session_window("ts", gap)
    keys = [window.alias("w"), *([F.col("path")] if per_path else [])]
    rows = changes.withWatermark("ts", late).groupBy(*keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(["path"] if per_path else []), "n")


def last_events(changes: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """(path, kind, ts, n): of each burst of changes to a path the last one. Of equal times a deletion is last."""
    order = F.struct("ts", (F.col("kind") == "delete").alias("d"), "kind")
    rows = changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.max(order).alias("m"), F.count("*").alias("n"))
    return rows.select("path", "m.kind", "m.ts", "n")


def catch_up(files: DataFrame, stored: DataFrame, apply: Callable[[DataFrame, DataFrame], None], key: str = "path", text: str = "text") -> dict[str, int]:
    """What has changed while nobody watched: ``apply(upserts, deletes)`` gets the paths whose file (key, mtime, text) is new or
    differs from the stored row, and those that are gone. How many of each action there were."""
    changes = sync.diff(files, stored, key, text).persist()
    counts = {r["action"]: r["n"] for r in sync.sync_counts(changes).collect()}  # a row an action
    if counts.keys() - {"unchanged"}:
        apply(changes.filter("action in ('added', 'updated')").select(key), changes.filter("action = 'removed'").select(key))
    changes.unpersist()
    return counts


def run(changes: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, gap: str | None = GAP, late: str = LATE, **trigger) -> StreamingQuery:
    """Starts applying bursts: ``apply(upserts, deletes)`` gets the paths whose burst of changes a quiet ``gap`` has ended, with
    its last event deciding; changes of a burst that goes on wait in the state. Without a gap each micro-batch is applied
    at once, with the last event of a path in it. ``trigger`` as of writeStream.trigger; stop the query to drop what is pending."""

    def batch(rows: DataFrame, _: int) -> None:
        last = rows.groupBy("path").agg(F.max_by("kind", F.struct("ts", (F.col("kind") == "delete"))).alias("kind"))
        last = last.persist()
        if not last.isEmpty():
            apply(last.filter("kind <> 'delete'").select("path"), last.filter("kind = 'delete'").select("path"))
        last.unpersist()

    events = expand_renames(notes_only(changes))
    events = last_events(events, gap, late) if gap else events
    writer = events.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
