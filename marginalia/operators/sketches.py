"""Profiles of fields with many values that are kept up by batches: mergeable sketches, and exact top values behind them.

A batch of notes leaves a sketch of the frequent values and one of the distinct values for each field, a few kilobytes, and
its values with their counts. A profile merges the sketches alone; the top values are then counted exactly, out of the rows of
the values that the sketch can't rule out. Where it can't rule out enough, as in a field whose values are about equally
frequent, the whole field is counted: the result is exact for every field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .profile import value_counts

#: Values that a sketch tracks, by default, and the logarithm of the registers that estimate how many there are (0.8 %).
TRACKED, REGISTERS = 1000, 14
#: A sketch tracks at most 3/4 of its map, and its error is at most 3.5 / map of all values, also after merging.
ERROR = 3.5 * 0.75
#: Occurrences of a value that are made rows at once, and all occurrences for which a sketch gets one more task.
RUN, TASK = 4096, 1 << 21


class FieldSketches:
    """The sketches in a folder. A batch is written under its number, and writing it again replaces it."""

    def __init__(self, spark: SparkSession, folder: str, tracked: int = TRACKED):
        self.spark, self.folder, self.tracked = spark, folder.rstrip("/"), tracked

    def add(self, fields: DataFrame, batch: int) -> None:
        """Adds a batch of ``fields`` (field, kind, values), as ``scan_fields`` gives them; null values don't count. They are read
        once, for the counts: the sketches are made out of these, a value as often as it occurs."""
        at = f"{self.folder}/values/batch={batch}"
        value_counts(fields).filter("value is not null").write.mode("overwrite").parquet(at)
        rows = fields.sparkSession.read.schema("field string, value string, n bigint").parquet(at)
        rows = rows.select("field", "value", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("from"))
        tasks = (rows.filter("from = 0").agg(F.sum("n")).first()[0] or 0) // TASK + 1  # the runs are few, what they become is not
        rows = rows.repartition(tasks, "value", "from").select("field", "value", F.explode(F.sequence("from", F.least(F.col("from") + RUN, F.col("n")) - 1)).alias("i"))
        frequent = F.call_function("approx_top_k_accumulate", F.col("value"), F.lit(self.tracked))
        distinct = F.hll_sketch_agg(F.when(F.col("i") == 0, F.col("value")), F.lit(REGISTERS))
        sketched = rows.groupBy("field").agg(F.count("*").alias("n"), frequent.alias("frequent"), distinct.alias("distinct"))
        sketched.write.mode("overwrite").parquet(f"{self.folder}/sketches/batch={batch}")

    def counts(self) -> DataFrame:
        """(field, value, n) over all batches: how often each value occurs."""
        return self.spark.read.parquet(f"{self.folder}/values").groupBy("field", "value").agg(F.sum("n").alias("n"))

    def merged(self) -> DataFrame:
        """(field, n, frequent, distinct): the sketches of all batches as one a field, and how many values there are."""
        combined = F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(self.tracked))
        rows = self.spark.read.parquet(f"{self.folder}/sketches")
        return rows.groupBy("field").agg(F.sum("n").alias("n"), combined.alias("frequent"), F.hll_union_agg("distinct").alias("distinct"))

    def profile(self) -> DataFrame:
        """(field, n, distinct, error): how many values, about how many different ones, and by how much the counts of the
        frequent-values sketch may be wrong. Reads sketches alone."""
        return self.merged().select("field", "n", F.hll_sketch_estimate("distinct").alias("distinct"), (F.col("n") * ERROR / self.tracked).alias("error"))

    def candidates(self, k: int) -> DataFrame:
        """(field, value): the values that may be among the first ``k`` of a field. A field isn't there if they can't be told."""
        items = F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(self.tracked))
        rows = self.merged().select("field", (F.col("n") * ERROR / self.tracked).alias("error"), items.alias("items"))
        # items come by falling estimates, which are off by the error at most; what isn't listed has at most twice the error
        least = F.get("items", F.lit(k - 1))["count"]
        rows = rows.withColumn("least", least).filter(F.col("least") > 3 * F.col("error"))
        return rows.select("field", "least", "error", F.inline("items").alias("value", "count")).filter(F.col("count") >= F.col("least") - 2 * F.col("error")).select("field", "value")

    def top(self, k: int = 10) -> DataFrame:
        """(field, value, n, place): the ``k`` most frequent values of each field, exactly; ties go to the value first by name."""
        values, told = self.spark.read.parquet(f"{self.folder}/values").drop("batch"), self.candidates(k)
        some = values.join(told, ["field", "value"], "left_semi")
        whole = values.join(told.select("field").distinct(), "field", "left_anti")
        counts = some.unionByName(whole).groupBy("field", "value").agg(F.sum("n").alias("n"))
        best = W.partitionBy("field", "part").orderBy(F.desc("n"), "value")
        # a field that is counted whole is ranked in parts first
        parts = counts.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(256))).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
        return parts.withColumn("place", F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "value"))).filter(F.col("place") <= k).select("field", "value", "n", "place")
