"""MinHash near-duplicate detection with tensored banding.

Two collections of ``SIDE`` sketches are made for a document, each sketch out of ``ROWS`` minimum hashes. Table (i, j)
is keyed by sketch i of the first collection with sketch j of the second, so SIDE*SIDE tables cost 2*SIDE sketches:
``2 * SIDE * ROWS`` = 32 minimum hashes instead of 256. Two documents of similarity s meet in some table with
probability (1 - (1 - s^ROWS)^SIDE)^2, 0.9999 at the default threshold of 0.85 and 0.9994 at 0.8.

Candidates are verified on full shingle sets. Documents with equal sets are collapsed first, and the members of a bucket
are compared with one hub B, so a large group of copies costs a star. Two members of different components may still be
linked, though only if one of them, U, isn't linked with B. Let E_X be the symmetric difference of X and B, which is A_X,
what X adds to B, and L_X, what it lacks. Then |X ^ Y| = |E_X ^ E_Y|, and with c = (1 - t) / (1 + t) a link means
|X ^ Y| <= h = c * (|X| + |Y|), so that E_U and E_Z share at least o = (|E_U| + |E_Z| - h) / 2 shingles; o > 0 since
|E_U| > c * (|U| + |B|). At most min(|L_U|, |L_Z|) of these are lacked, so A_U and A_Z share at least p = o - min(|L_U|, |L_Z|) =
(|A_U| + |A_Z| + abs(|L_U| - |L_Z|) - h) / 2. Where p > 0 the pair meets in a join on added shingles alone, which are rare, while
all members of a template lack the same. Where p <= 0, one of the two adds at most c times its size; only items that such a
slim member has take part in a second join, prefix-filtered on all of E: in order of rarity, the first shared shingle
stands among the first |E_Z| - o + 1 <= (1 + c) / 2 * |E_Z| + 1 of E_Z. In both joins, from the place of the shared shingle on
both sets must have as many shingles left as they have to share. Every link between components is among the pairs
verified. Every step is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .kernels import UP, Tokens, U, chunks, grams, lists, list_values, mix, signed
from .storage import Bloom, Work, join_hot

WORDS, SIDE, ROWS = 5, 8, 2
LINK, OF = 85, 100
_HASHES = 2 * SIDE * ROWS
_random = np.random.default_rng(20240501)
_A = _random.integers(0, 1 << 63, _HASHES, dtype=np.int64).astype(U) * U(2) + U(1)
_B = _random.integers(0, 1 << 63, _HASHES, dtype=np.int64).astype(U)
SKETCH = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>"
BLOCK, MOST_SEEN = 1 << 16, 1 << 17


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer words, the whole sequence is the one shingle."""
    for _, _, data, at in chunks(column):
        tokens = Tokens(data, at, lower=True)
        h = tokens.hashes()
        g = grams(h, words)
        for i, n in enumerate(tokens.count):
            s = tokens.first[i]
            if n >= words:
                yield np.unique(g[s : s + n - words + 1])
            elif n:
                yield grams(h[s : s + n], int(n))
            else:
                yield np.zeros(0, U)


def _minima(values: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set, in blocks of bounded size."""
    least = np.full(_HASHES, ~U(0))
    for k in range(0, len(values), BLOCK):
        np.minimum(least, mix(values[k : k + BLOCK, None] * _A + _B).min(axis=0), out=least)
    return least


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, keys = [], [], []
            for values in shingle_sets(batch.column(1), words):
                n.append(len(values))
                digests.append(_digest(values))
                if len(values):
                    keys.append((mix(_minima(values)).reshape(2 * SIDE, ROWS) * UP[1 : ROWS + 1]).sum(axis=1, dtype=U))
            flat = np.concatenate(keys) if keys else np.zeros(0, U)
            d = np.array(digests, U).reshape(-1, 2)
            lengths = np.where(np.array(n, np.int64) > 0, 2 * SIDE, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n, np.int64)), pa.array(signed(d[:, 0].copy())), pa.array(signed(d[:, 1].copy())), lists(signed(flat), lengths)], ["doc_id", "n_shingles", "d1", "d2", "keys"])

    return run


def _digest(values: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums that tell sets apart."""
    return mix(values + U(7)).sum(dtype=U), mix(values * _A[0]).sum(dtype=U)


def _sets(words: int, filled):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            places, _ = list_values(batch.column(2))
            batch = batch.filter(pa.array(Bloom.passing(filled.value, places)))
            for k in range(0, batch.num_rows, 256):
                part, kept, sets, digests = batch.slice(k, 256), [], [], []
                for i, values in enumerate(shingle_sets(part.column(1), words)):
                    own = (part.column(0)[i].as_py(), *_digest(values))
                    if own not in seen:  # repeated rows make one set a partition
                        seen.add(own)
                        kept.append(i)
                        sets.append(values)
                        digests.append(own[1])
                if len(seen) > MOST_SEEN:
                    seen.clear()
                flat = np.concatenate(sets) if sets else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), pa.array(signed(np.array(digests, U))), lists(signed(flat), [len(x) for x in sets])], ["id", "d", "items"])

    return run


def _linked(x: Column, y: Column, similarity: int) -> Column:
    """Whether two sets are similar enough."""
    both = F.size(F.array_intersect(x, y))
    return F.lit(OF) * both >= F.lit(similarity) * (F.size(x) + F.size(y) - both)


def _sets_of(work: Work, docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(id, items) of the documents in ``pairs`` (a, b), one row for each id and set. Only their sets are made and moved."""
    ids = work.cut(pairs.select("a").union(pairs.select("b")).distinct().toDF("id"), "ids")
    bloom = Bloom(ids, "id")
    texts = docs.select("doc_id", "text", bloom.places("doc_id").alias("places"))
    sets = texts.mapInArrow(_sets(words, bloom.words), "id bigint, d bigint, items array<bigint>").join(ids, "id", "left_semi")
    return work.cut(sets.dropDuplicates(["id", "d"]).select("id", "items"), "sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the sets x of a and y of b."""
    a, b = (sets.select(F.col("id").alias(i), F.col("items").alias(v)) for i, v in (("a", "x"), ("b", "y")))
    return pairs.join(a, "a").join(b, "b")


def _between(work: Work, pairs: DataFrame, sets: DataFrame, labels: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) of members of one hub's group, of different components, that may be linked.

    ``pairs`` (a: hub, b: member, linked, n: the member's size) are all members of all hubs. Only what members of
    different components share can make a pair, so items that one component alone has are left out before pairs are made.
    """
    members = pairs.join(labels.select(F.col("node").alias("b"), "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    mixed = members.groupBy("a").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("linked").alias("all")).filter("lo <> hi and not all").select("a")
    # written, so that the join with the sets has nothing before it and Spark can split the rows of a hub with many members
    members = work.cut(members.join(mixed, "a", "left_semi"), "members")
    parts = _with_sets(members, sets).select("a", "b", "n", "linked", "label", F.array_except("y", "x").alias("added"), F.array_except("x", "y").alias("lacked"))
    parts = parts.withColumn("adds", F.size("added")).withColumn("lacks", F.size("lacked"))
    c = F.lit((OF - similarity) / (OF + similarity))
    marked = F.concat(*[F.transform(x, _marked(x == "added")) for x in ("added", "lacked")])
    items = parts.select("a", "b", "n", "linked", "label", "adds", "lacks", (F.col("adds") <= c * F.col("n") + F.lit(1e-6)).alias("slim"), F.explode(marked).alias("e"))
    items = work.cut(items.select("a", "b", "n", "linked", "label", "adds", "lacks", "slim", "e.item", "e.own"), "items")
    near = F.lit(OF) * F.least("n", "u_n") >= F.lit(similarity) * F.greatest("n", "u_n")
    met = (F.col("label") != F.col("u_label")) & near
    apart = F.col("adds") + F.col("u_adds") + F.abs(F.col("lacks") - F.col("u_lacks")) - c * (F.col("n") + F.col("u_n")) - F.lit(1e-6)
    found = []
    for name, rows, chosen in (("added", items.filter("own"), F.lit(True)), ("lacked", items, F.col("some_slim"))):
        rarity = rows.groupBy("a", "item").agg(F.count("*").alias("rows"), F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("adds").alias("least_adds"), F.max("n").alias("most_n"), F.bool_or("slim").alias("some_slim"))
        shared = join_hot(rows, rarity.filter("lo <> hi").filter(chosen).drop("lo", "hi", "some_slim"), ["a", "item"], "rows", rows.count())
        # items left out come first in the order and make no pair: the place of the others is counted from there
        order, own = W.partitionBy("a", "b").orderBy("df", "item"), W.partitionBy("a", "b")
        shared = shared.withColumn("left", F.count("*").over(own) - F.row_number().over(order) + 1)
        if name == "added":
            # what is left must hold what any other member with the item would have to share
            most = F.least(F.col("most_n"), F.col("n") * OF / F.lit(similarity))
            shared = shared.filter(2 * F.col("left") >= F.col("adds") + F.col("least_adds") - c * (F.col("n") + most) - F.lit(1e-6))
        shared = work.cut(shared.select("a", "item", "b", "n", "linked", "label", "adds", "lacks", "slim", "left"), name)
        u = shared.filter("not linked").select("a", "item", *[F.col(x).alias(f"u_{x}") for x in ("b", "n", "label", "adds", "lacks", "slim", "left")])
        if name == "added":
            z, enough = shared, 2 * F.least("left", "u_left") >= apart
        else:
            m = F.col("adds") + F.col("lacks")
            overlap = m + F.col("u_adds") + F.col("u_lacks") - c * (F.col("n") + F.col("u_n")) - F.lit(1e-6)
            z = shared.filter(m - F.col("left") <= F.floor((1 + c) / 2 * m) + 1)
            enough = (F.col("slim") | F.col("u_slim")) & (apart <= 0) & (2 * F.least("left", "u_left") >= overlap)
        both = u.join(z, ["a", "item"]).filter(met & enough).select(F.least("b", "u_b").alias("a"), F.greatest("b", "u_b").alias("b"))
        found.append(work.cut(both.distinct(), "between"))
        work.drop(shared)
    work.drop(members, items)
    return found[0].union(found[1]).distinct()


def _marked(own: bool):
    return lambda x: F.struct(x.alias("item"), F.lit(own).alias("own"))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = LINK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text; other columns are ignored).
    Documents whose shingle sets have a Jaccard similarity of ``similarity`` hundredths or more are linked.

    Null, empty and white texts have no shingles: they link with nothing and are kept. Repeated rows form one
    component; rows that share a doc_id count as one document. A row without a doc_id is kept; it has the component
    of the documents with an equal set, if any, and else null. A very long text is compared as a whole, like others; its
    set is made by one task, in blocks. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Work(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = work.cut(docs.mapInArrow(_sketches(words), SKETCH), "sketch")
    nodes = work.cut(sketch.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "nodes")

    tables = [F.xxhash64(F.lit(i * SIDE + j), F.col("keys")[i], F.col("keys")[SIDE + j]) for i in range(SIDE) for j in range(SIDE)]
    rows = nodes.filter("rep is not null").select("rep", "n", F.explode(F.array(*tables)).alias("k"))
    hubs = rows.groupBy("k").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).filter("size > 1").drop("size")
    pairs = work.cut(rows.join(hubs, "k").filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"), "n").distinct(), "pairs")
    sets = _sets_of(work, docs, pairs, words)
    pairs = work.cut(_with_sets(pairs, sets).select("a", "b", "n", _linked(F.col("x"), F.col("y"), similarity).alias("linked")), "pairs")
    links = pairs.filter("linked").select("a", "b")
    labels = components(work, links)
    more = _between(work, pairs, sets, labels, similarity)
    more = work.cut(_with_sets(more, sets).filter(_linked(F.col("x"), F.col("y"), similarity)).select("a", "b"), "links")
    if not more.isEmpty():
        labels = components(work, links.unionByName(more))
    work.keep(sketch, nodes, labels)

    rep = sketch.join(nodes.select("d1", "d2", "rep"), ["d1", "d2"], "left")
    out = rep.join(labels, rep["rep"] == labels["node"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "rep")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))
