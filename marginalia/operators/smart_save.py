"""Smart saving of many notes at once: each request is judged against the index and against the requests before it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .knn import DIGITS, knn_join, similar_pairs
from .save import CLOSEST, SIMILAR


def _earlier_pairs(requests: DataFrame, least: float) -> DataFrame:
    """(a, b, score): the request b and a similar one, a, before it."""
    return similar_pairs(requests.filter("exists(vec, x -> x <> 0)"), "id", "vec", least)


def _resolve(pairs: DataFrame, judged: DataFrame, folder: str) -> DataFrame:
    """(id, created) of judged requests (id, taken), as if they had come one by one: a request is created if it isn't taken and no
    similar one before it is created. Each round decides the requests all of whose similar predecessors are decided, and
    what follows from them; its result is a written table."""
    spark, schema = judged.sparkSession, "id bigint, created boolean"

    def cut(df: DataFrame, name: str, columns: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(columns).parquet(f"{folder}/{name}")

    open_pairs = judged.filter("not taken").select("id")
    pairs = cut(pairs.select("a", "b").join(open_pairs.withColumnRenamed("id", "a"), "a", "left_semi").join(open_pairs.withColumnRenamed("id", "b"), "b", "left_semi"), "pairs-0", "a bigint, b bigint")
    met = pairs.select("b").distinct().withColumnRenamed("b", "id")
    done = cut(judged.filter("taken").select("id", F.lit(False).alias("created")).unionByName(open_pairs.join(met, "id", "left_anti").withColumn("created", F.lit(True))), "done-0", schema)
    k = 0
    while not pairs.isEmpty():
        k += 1
        # those after a created one are not; then pairs with a decided end say nothing more
        refused = pairs.join(done.filter("created").select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().withColumn("created", F.lit(False))
        refused = cut(refused, f"refused-{k}", schema)
        both = refused.select("id")
        rest = pairs.join(both.withColumnRenamed("id", "b"), "b", "left_anti")
        waiting = rest.select("b").distinct().withColumnRenamed("b", "id")
        after = cut(rest.join(both.withColumnRenamed("id", "a"), "a", "left_anti"), f"pairs-{k}", "a bigint, b bigint")
        # whom no undecided one precedes any longer is created
        free = waiting.join(after.select("b").distinct().withColumnRenamed("b", "id"), "id", "left_anti").withColumn("created", F.lit(True))
        done = cut(done.unionByName(refused).unionByName(free), f"done-{k}", schema)
        pairs = after
    return done


def smart_save(requests: DataFrame, index: DataFrame, least: float = SIMILAR, folder: str | None = None) -> DataFrame:
    """(id, decision, close) for each of the requests (id, vec), in the order of their ids: ``needs_decision`` if a note of the index
    (id, vec) or a request that was created before is at least so similar, else ``create``; ``close`` are the most similar of
    these, at most CLOSEST: (request, id, score), best first, notes before requests.

    Requests that are alike are judged once: those after the first need a decision whatever becomes of it. A request without a
    vector, or with one that has no direction, is like nothing and is created. Ids are distinct and not null. The number of
    rounds is the length of the longest chain of similar requests of which each waits for the one before.
    """
    folder = folder or f"{shared_folder(requests.sparkSession)}/smart-{uuid.uuid4().hex}"
    spark = requests.sparkSession
    requests = requests.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    turned = F.exists("vec", lambda x: x != 0)
    first = requests.filter(turned).groupBy("vec").agg(F.min("id").alias("first"))
    members = requests.filter(turned).join(first, "vec").select("id", "first")
    distinct = first.select(F.col("first").alias("id"), "vec")
    # requests have negative numbers here, so that none is left out for having the number of a note
    near = knn_join(index.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")), distinct.withColumn("id", -1 - F.col("id")), CLOSEST, "id", "vec")
    near = near.filter(F.col("score") >= least).select((-1 - F.col("query_id")).alias("first"), F.lit(False).alias("request"), "id", F.round("score", DIGITS).alias("score"))
    near.write.parquet(f"{folder}/near")
    near = spark.read.schema("first bigint, request boolean, id bigint, score double").parquet(f"{folder}/near")
    pairs = _earlier_pairs(distinct, least)
    pairs.write.parquet(f"{folder}/pairs")
    pairs = spark.read.schema("a bigint, b bigint, score double").parquet(f"{folder}/pairs")
    judged = distinct.select("id").join(near.select(F.col("first").alias("id")).distinct().withColumn("taken", F.lit(True)), "id", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
    done = _resolve(pairs, judged, folder)

    created = done.filter("created").select("id")
    # a request that is like an earlier one may also be close to what was created between the two
    either = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    of_requests = either.join(created.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("first"), F.lit(True).alias("request"), F.col("a").alias("id"), "score")
    # the likes of a created request are close to it too
    twins = members.filter("id <> first").join(created.withColumnRenamed("id", "first"), "first", "left_semi").select("id", F.struct((-F.lit(1.0)).alias("s"), F.lit(True).alias("request"), F.col("first").alias("id"), F.lit(1.0).alias("score")).alias("x"))
    listed = near.unionByName(of_requests).select("first", F.struct((-F.col("score")).alias("s"), "request", "id", "score").alias("x"))
    close = members.join(listed, "first").filter(~F.col("x.request") | (F.col("x.id") < F.col("id"))).select("id", "x").unionByName(twins).groupBy("id").agg(F.slice(F.array_sort(F.collect_list("x")), 1, CLOSEST).alias("x"))
    close = close.select("id", F.transform("x", lambda x: F.struct(x["request"].alias("request"), x["id"].alias("id"), x["score"].alias("score"))).alias("close"))
    decided = members.join(done.withColumnRenamed("id", "first"), "first").select("id", F.when((F.col("id") == F.col("first")) & F.col("created"), "create").otherwise("needs_decision").alias("decision"))
    out = requests.select("id").join(decided, "id", "left").join(close, "id", "left")
    return out.select("id", F.coalesce("decision", F.lit("create")).alias("decision"), F.coalesce("close", F.array().cast("array<struct<request:boolean,id:bigint,score:double>>")).alias("close"))
