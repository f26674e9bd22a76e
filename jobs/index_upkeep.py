"""Keeps a keyword index in step with a growing table of notes.

A file stream takes the files that are new since the last run; its checkpoint is the mark. Each batch becomes a segment of the
index, under a number that follows from the batch, so a batch that is run again replaces what its first run left. Notes whose
texts are as they were are left alone; after some segments all are merged into one.

    python -m jobs.index_upkeep --source /data/notes --target /data/index --checkpoint /data/index-mark --config jobs/index_upkeep.json
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, read_config
from marginalia.operators.segments import SegmentedIndex

#: The key of a note and its type; the indexed fields, as SQL over the source's columns; which row of a key counts, and which say that
#: a note is gone (SQL, or none); files a batch at most; segments before they are merged.
DEFAULTS = {"key": "doc_id", "kind": "bigint", "fields": {"title": "concat('doc-', doc_id)", "body": "text"}, "order": None, "gone": None, "files_per_batch": 1000, "segments": 8}
#: Segment numbers a batch: what it adds, what it removes, and the merged index.
STEPS = 3


def index_of(spark: SparkSession, target: str, config: dict) -> SegmentedIndex:
    return SegmentedIndex(spark, target, config["key"], {name: F.expr(sql) for name, sql in config["fields"].items()}, kind=config["kind"])


def apply(batch: DataFrame, number: int, target: str, config: dict) -> None:
    """The rows of a batch into the index."""
    index, key = index_of(batch.sparkSession, target, config), config["key"]
    rows = batch.withColumn("_order", F.expr(config["order"]) if config["order"] else F.lit(0))
    gone = F.coalesce(F.expr(config["gone"]), F.lit(False)) if config["gone"] else F.lit(False)
    if config["gone"]:
        # what counts of a key is its last row: of equal ones that which says it is gone
        last = rows.groupBy(key).agg(F.max_by(gone, F.struct("_order", gone.alias("g"))).alias("_gone"))
        rows = rows.filter(~gone).join(last.filter("not _gone").select(key), key, "left_semi")
    index.add(rows, STEPS * number, order="_order")
    if config["gone"]:
        index.remove(last.filter("_gone").select(key), STEPS * number + 1)
    if len(index.segments()) > config["segments"]:
        index.compact(STEPS * number + 2)
    log("index_upkeep").info("batch %d: read %d new rows; the index in %s has %d notes in segments %s", number, batch.count(), target, index.notes, index.segments())


def as_stream(table: DataFrame, source: str) -> str:
    """The path of a file stream over a table. Such a stream takes a single file as a pattern only."""
    files, source = table.inputFiles(), source.rstrip("/")
    return f"{source[:-1]}[{source[-1]}]" if len(files) == 1 and files[0].endswith(source.rpartition("/")[2]) else source


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: dict | None = None) -> SegmentedIndex:
    """Takes what is new in ``source`` (Parquet) into the index in ``target``, and returns the index."""
    c = DEFAULTS | (config or {})
    table = spark.read.parquet(source)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(as_stream(table, source))
    query = stream.writeStream.foreachBatch(lambda batch, number: apply(batch, number, target, c)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log("index_upkeep").info("%s is read up to batch %d", source, max((p["batchId"] for p in query.recentProgress), default=-1))
    return index_of(spark, target, c)


if __name__ == "__main__":
    command_line("index_upkeep", __doc__, ("source", "target", "checkpoint"), lambda spark, a: run(spark, a.source, a.target, a.checkpoint, read_config(spark, a.config, DEFAULTS)))
