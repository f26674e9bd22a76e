"""Mixing sources to target weights, with DataFrame operations only.

Texts are read once, for a small table of sizes; rows that are alike in it are one row with a count, so that no id or text,
however often it is repeated, makes a hot key. Each document gets a hash key, random but reproducible. A source is sorted
by the key: its leading bits make key ranges of some ``RANGE`` rows, so that no source, however large, is sorted in one
task. Sums over groups of ``GROUP`` ranges and over the ranges of a group give each range its offset, a running sum inside
the range gives each document its place, and the source is cut exactly at its budget; a budget beyond the source's size
takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import Work

WEIGHTS, LIMIT = (5, 2, 1), 3
RANGE, GROUP, REPEATS = 1 << 10, 1 << 12, 1 << 16


def size_of(text: Column) -> Column:
    """The number of runs of bytes other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, null last, have the weights in turn. The targets share the sum of all sizes by weight, none
    above ``limit`` times its source. In order of limit/weight, a source is at its limit if its share of what the
    sources before it leave is no less; the others share the rest by weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    named = named.withColumn("cap", F.col("source_size") * limit)
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    named = named.withColumn("left", left).withColumn("of", weight).withColumn("capped", F.col("cap") * F.col("of") <= F.col("left") * F.col("weight"))
    rest = F.sum(F.when(F.col("capped"), -F.col("cap")).otherwise(0)).over(every) + F.sum("source_size").over(every)
    open_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((rest * F.col("weight")).cast("double") / open_weight.cast("double"))
    return named.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of ``docs`` (doc_id, source, text).

    ``taken`` is how many of the document's words the mix takes, repeats counted: whole epochs of the source, then the
    documents in key order up to the budget; the document at the cut gives a part. The taken words of a source add up to
    its target, rounded. A null text has size 0 and gives nothing; null is a source of its own; rows with one doc_id
    have one key and are ordered by size; rows without a doc_id have the key of their text. A very long text is
    counted where it is read and moved nowhere. An empty table gives an empty result. Reruns agree for a seed.
    """
    work = Work(docs.sparkSession, "mix")
    spread = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    spread = spread.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), named)).alias("key"))
    spread = work.cut(spread.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n")), "sizes")
    buckets = 1 << (spread.count() // RANGE).bit_length()
    # the leading 32 bits of the key: as many ranges as there are buckets
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / ((1 << 32) // buckets)).cast("long")
    spread = spread.withColumn("bucket", bucket).withColumn("words", F.col("size") * F.col("n"))

    # prefix sums in two steps: of the groups in a source, of the ranges in a group
    ranges = spread.groupBy("source", "bucket").agg(F.sum("words").alias("words")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = ranges.groupBy("source", "group").agg(F.sum("words").alias("words"))
    goal = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, limit)
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select(F.col("source").alias("of"), F.col("group").alias("in"), before.alias("before"))
    ranges = ranges.join(groups, F.col("source").eqNullSafe(F.col("of")) & (F.col("group") == F.col("in")))
    in_order = W.partitionBy("source", "group").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("source", "bucket", (F.col("before") + F.coalesce(F.sum("words").over(in_order), F.lit(0))).alias("offset"))
    goal = goal.withColumnRenamed("source", "of")
    ranges = ranges.join(goal, F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("bucket").alias("range"), "offset", "source_size", "target")

    placed = spread.join(ranges, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("range")))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("words").over(inside), F.lit(0))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("start", start).withColumn("epochs", epochs)
    # the rows that are alike follow one another; long runs of them are counted in steps
    placed = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS).cast("long"))))
    placed = placed.withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + REPEATS, F.col("n")) - 1)))
    placed = placed.withColumn("start", F.col("start") + F.col("nth") * F.col("size"))
    part = F.least("size", F.greatest(F.lit(0), budget - F.col("epochs") * F.col("source_size") - F.col("start")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
