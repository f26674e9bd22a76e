"""Benchmark decontamination as a prefix-filtered set join, with DataFrame operations only.

A benchmark window is a set of positioned shingles of ``SHINGLE`` words. Since containment must be complete, one token
of a window is a sufficient prefix: the shingle of the window that is rarest in the documents. One pass over the
documents keeps the positions of shingles that occur in the benchmark; their counts give the rarity order. Each rarest
shingle then proposes a start of its window, the length and positional bounds drop starts outside the document, and a
proposal is verified when every shingle of the window stands at its own offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import Work

WINDOW, SHINGLE = 13, 3
#: With more distinct benchmark shingles than this, of at most so many bytes, the corpus pass shuffles instead of broadcasting.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, with A-Z lower-cased; null has none. Pure ASCII takes the faster lower()."""
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(plain, F.lit("")), GAP), lambda w: w != "")


def _join(parts: list[Column]) -> Column:
    """Words contain no space, so that the joined text tells the words apart."""
    return F.concat_ws(" ", *parts)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, found, members): a row (rid, doc_id, n_words) for each document; (rid, wid, start, n) for each window that
    occurs in it at word ``start``; (wid, item_id) for the items that hold the window."""
    spark = docs.sparkSession
    work = Work(spark, "decontaminate")

    items = benchmark.select("item_id", words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("n", F.least(F.size("w"), F.lit(window)))
    windows = items.select("item_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("text"))
    windows = windows.select(F.sha2("text", 256).alias("wid"), "item_id", "n", "text").distinct()
    windows = work.cut(windows, "windows")
    members = windows.select("wid", "item_id").distinct()
    each = windows.select("wid", "n", F.split("text", " ").alias("w"), F.least("n", F.lit(shingle)).alias("k")).dropDuplicates(["wid"])
    each = each.select("wid", "n", "k", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("off", "shingle"))
    each = work.cut(each, "shingles")

    known = work.cut(each.select("k", "shingle").distinct(), "known")
    size = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("shingle")).alias("b"), F.collect_set("k").alias("ks")).first()
    lengths = sorted(size["ks"]) or [shingle]
    lookup = F.broadcast(known.select("shingle", F.lit(True).alias("hit"))) if size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= BROADCAST_BYTES else known.select("shingle", F.lit(True).alias("hit"))

    deal = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(F.col("text").cast("string")).alias("w"))
    longest = max(lengths)
    shifted = [F.col("w")] + [F.slice("w", j + 1, F.greatest(F.size("w") - j, F.lit(0))) for j in range(1, longest)]
    zipped = F.arrays_zip(*[c.alias(f"w{j}") for j, c in enumerate(shifted)])
    spread = deal.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(zipped).alias("pos", "z"))
    parts = [F.col("z")[f"w{j}"] for j in range(longest)]
    shingles = [F.when(parts[k - 1].isNotNull(), _join(parts[:k])) for k in lengths]
    if len(shingles) == 1:
        tokens = spread.select("rid", "doc_id", "n_words", "pos", shingles[0].alias("shingle"))
    else:  # the benchmark has items of fewer words than a shingle
        tokens = spread.select("rid", "doc_id", "n_words", "pos", F.explode(F.array(*shingles)).alias("shingle"))
    matched = tokens.join(lookup, "shingle", "left").filter("hit is not null or pos is null or pos = 0")
    matched = work.cut(matched.select("rid", "doc_id", "n_words", "pos", F.when(F.col("hit"), F.col("shingle")).alias("shingle")), "matched")

    rows = matched.filter("pos is null or pos = 0").select("rid", "doc_id", "n_words").distinct()
    at = matched.filter("shingle is not null").select("rid", "n_words", "pos", "shingle")
    rarity = at.groupBy("shingle").agg(F.count("*").alias("df"))
    prefix = each.join(rarity, "shingle").groupBy("wid", "n", "k").agg(F.min(F.struct("df", "off", "shingle")).alias("p"), F.count("*").alias("present"))
    # a window with a shingle that no document has occurs nowhere
    prefix = prefix.filter(F.col("present") == F.col("n") - F.col("k") + 1).select("wid", "n", F.col("p.off").alias("off"), F.col("p.shingle").alias("shingle"))
    proposed = at.join(prefix, "shingle").select("rid", "wid", "n", (F.col("pos") - F.col("off")).alias("start"), "n_words").filter("start >= 0 and start + n <= n_words").drop("n_words")
    needs = proposed.join(each.drop("n", "k"), "wid").withColumn("pos", F.col("start") + F.col("off"))
    found = needs.join(at.select("rid", "pos", "shingle"), ["rid", "pos", "shingle"]).groupBy("rid", "wid", "start", "n").agg(F.count("*").alias("matches"))
    found = work.cut(found.filter(F.col("matches") == F.col("n") - F.least("n", F.lit(shingle)) + 1).drop("matches"), "found")
    work.keep(windows, matched, found)
    return rows, found, members


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``docs``.

    A document is contaminated if a ``share``-th of its words or more lie in windows of ``window`` benchmark words.
    Null, empty and wordless texts have no words and are clean; items without words match nothing; items with equal
    windows all count; a null item_id counts as no item, though its windows hit. Repeated rows each get a row.
    A very long text is a row like others: its words are one array and its shingles a stream of rows. An empty table gives
    an empty result, an empty benchmark clean documents. Columns other than doc_id, text and item_id are ignored.
    """
    rows, found, members = occurrences(docs, benchmark, window)
    # words covered by any occurrence: each adds what lies beyond the furthest end so far
    ordered = W.partitionBy("rid").orderBy("start", "n").rowsBetween(W.unboundedPreceding, -1)
    spans = found.select("rid", "start", "n").distinct().withColumn("done", F.coalesce(F.max(F.col("start") + F.col("n")).over(ordered), F.lit(0)))
    hits = spans.groupBy("rid").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", "done"))).cast("long").alias("n_hit"))
    items = found.select("rid", "wid").distinct().join(members, "wid").groupBy("rid").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = rows.join(hits, "rid", "left").join(items, "rid", "left")
    n_hit, held = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(held).cast("long").alias("n_items"), F.sha2(F.array_join(held, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
