"""An inverted index in blocks of notes, whose top hits are found without reading most postings.

Notes are dealt into zones by length, and within a zone into blocks of ``BLOCK`` notes of about the same length. The index has
a row for each block, field and term: the postings, packed, and the most that any of them can add to a score. A search
reads these maxima alone first, a few bytes a block; the ``limit`` blocks with the greatest sums hold at least that many
hits, whose last score is a bound that the final hits reach. Only blocks whose sum reaches it are read: the result is that
of ``bm25``, ties included. Zones are cut out of the notes of a task, where they are: no text or posting is shuffled, sorted by
Spark or spilled. A zone's rows are sorted by field, term and block, so a scan skips pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import index_terms
from .knn import pieces
from .search import BOOSTS, _idf, _part, index_fields, query_terms

#: Notes of a block (a power of two), and notes and words of a zone at most; a note of more words is a zone.
BLOCK, ZONE, WORDS = 64, 1 << 13, 1 << 22
#: Bytes of the dictionary that a column of keys may have.
KEYS = 8 << 20
#: Blocks that a scan is given as a list; more of them are joined.
LISTED = 4096
#: Scores are rounded to nine digits, sums of maxima aren't.
SLACK = 1e-8
BLOCKS = "block bigint, field string, term string, df bigint, top double, notes array<struct<key: {kind}, tf: int, dl: int>>, zone bigint"
PACKED = "block bigint, field string, term string, df bigint, notes array<struct<key: {kind}, tf: int, dl: int>>, zone bigint"
FIELDS = "field string, n bigint, words bigint"


def _zones(batches: Iterator[pa.RecordBatch], most: int, words: int) -> Iterator[pa.Table]:
    """The notes (key, row, and a list of terms for each field) in runs of at most ``most`` notes and so many words."""
    held, notes, room = [], 0, words
    for batch in batches:
        ends = np.cumsum(sum(np.asarray(c.value_lengths()).astype(np.int64) for c in batch.columns[2:]))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            fit = max(np.searchsorted(ends, before + room, "right"), at if held else at + 1)
            end = int(min(at + most - notes, fit))
            if end > at:
                held.append(batch.slice(at, end - at))
                notes, room, at = notes + end - at, room - (ends[end - 1] - before), end
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, notes, room = [], 0, words
    if held:
        yield pa.Table.from_batches(held)


def _packed(zone: pa.Table, field: str, block: int) -> pa.RecordBatch:
    """The rows of a zone for a field, without what they can add; sorted by term and block. Blocks are cut by length in words of all fields."""
    first, keys, lists = zone["row"][0].as_py(), zone["key"].combine_chunks(), zone[f"of {field}"].combine_chunks()
    sizes = [np.asarray(c.combine_chunks().value_lengths()) for c in zone.columns[2:]]
    by_length = np.argsort(sum(s.astype(np.int64) for s in sizes), kind="stable")
    place, dl = np.empty(len(by_length), np.int64), np.asarray(lists.value_lengths())
    place[by_length] = np.arange(len(by_length))
    # a posting is a number: the place of its term in the alphabet, then that of its note by length
    coded = lists.flatten().dictionary_encode()
    alphabet = np.asarray(pc.array_sort_indices(coded.dictionary))
    code = np.empty(len(alphabet), np.int64)
    code[alphabet] = np.arange(len(alphabet))
    posts, tf = np.unique(code[np.asarray(coded.indices)] * len(place) + np.repeat(place, dl), return_counts=True)
    term, note = posts // len(place), posts % len(place)
    at = note // block
    start = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
    bounds, note = np.append(start, len(posts)), by_length[note]
    each = pa.StructArray.from_arrays([keys.take(pa.array(note)), pa.array(tf.astype(np.int32)), pa.array(dl[note].astype(np.int32))], ["key", "tf", "dl"])
    arrays = [pa.array(first + at[start]), pa.repeat(pa.scalar(field), len(start)), coded.dictionary.take(pa.array(alphabet[term[start]])), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), each), pa.repeat(pa.scalar(first), len(start))]
    return pa.RecordBatch.from_arrays(arrays, ["block", "field", "term", "df", "notes", "zone"])


def _part_of(sizes: dict[str, tuple[int, int]], tf: Column, dl: Column) -> Column:
    """What a posting of the column ``field`` adds to a score, before its weight."""
    out = F.lit(0.0)
    for f, (n, words) in sizes.items():
        out = F.when(F.col("field") == f, _part(tf, dl, words / max(n, 1))).otherwise(out)
    return out


class BlockIndex:
    """The index in a folder, of notes with a key of type ``kind``. It is searched by words: signs and phrases are read as words, ``StoredIndex`` knows them."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "string"):
        self.blocks = spark.read.schema(BLOCKS.format(kind=kind)).parquet(f"{folder}/blocks")
        self.sizes = {r["field"]: (r["n"], r["words"]) for r in spark.read.schema(FIELDS).parquet(f"{folder}/fields").collect()}  # a row a field

    @staticmethod
    def write(notes: DataFrame, folder: str, key: str = "path", columns: dict[str, Column] | None = None, block: int = BLOCK) -> BlockIndex:
        """Writes the index of all ``notes``, whose ``key`` is unique, into a new folder. ``block`` is a power of two."""
        spark, columns = notes.sparkSession, columns or index_fields(notes)
        each = F.array(*[F.struct(F.lit(f).alias("field"), index_terms(c).alias("terms")) for f, c in columns.items()])
        rows = notes.select(F.col(key).alias("key"), each.alias("fields"))
        sizes = rows.select(F.explode("fields").alias("x")).groupBy("x.field").agg(F.count("*").alias("n"), F.sum(F.size("x.terms")).cast("long").alias("words"))
        sizes.write.parquet(f"{folder}/fields")
        held = {r["field"]: (r["n"], r["words"]) for r in spark.read.schema(FIELDS).parquet(f"{folder}/fields").collect()}  # a row a field
        kind, fields, most, words = notes.schema[key].dataType.simpleString(), list(columns), ZONE, WORDS

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for zone in _zones(batches, most, words):
                for field in fields:
                    yield from pieces([_packed(zone, field, block)], most)

        rows = notes.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), *[index_terms(c).alias(f"of {f}") for f, c in columns.items()])
        packed = rows.mapInArrow(pack, PACKED.format(kind=kind))
        # the most of a block, by the formula of a search
        top = F.array_max(F.transform("notes", lambda x: _part_of(held, x["tf"], x["dl"])))
        packed.withColumn("top", top).write.option("compression", "zstd").option("parquet.dictionary.page.size", KEYS).parquet(f"{folder}/blocks")
        return BlockIndex(spark, folder, kind)

    @property
    def notes(self) -> int:
        """How many notes there are."""
        return max((n for n, _ in self.sizes.values()), default=0)

    def _weights(self, query: str, boosts: dict[str, float] | None) -> dict[tuple[str, str], float]:
        """What a field and term of the query weigh. Those that no note has are left out."""
        boosts, terms = {f: b for f, b in (boosts or BOOSTS).items() if f in self.sizes and b}, query_terms(query)
        wanted = self.blocks.filter(F.col("term").isin(*terms) & F.col("field").isin(*boosts)) if terms and boosts else self.blocks.limit(0)
        found = wanted.groupBy("field", "term").agg(F.sum("df").alias("df")).collect()  # a row a field and term of the query
        return {(r["field"], r["term"]): boosts[r["field"]] * _idf(self.sizes[r["field"]][0], r["df"]) for r in sorted(found)}

    @staticmethod
    def _weighed(rows: DataFrame, weights: dict[tuple[str, str], float]) -> DataFrame:
        weight = F.lit(0.0)
        for (f, t), w in weights.items():
            weight = F.when((F.col("field") == f) & (F.col("term") == t), F.lit(w)).otherwise(weight)
        return rows.filter(F.col("term").isin(*{t for _, t in weights}) & F.col("field").isin(*{f for f, _ in weights})).withColumn("weight", weight)

    def _scored(self, rows: DataFrame, key: str) -> DataFrame:
        each = rows.select("field", "weight", F.explode("notes").alias("x"))
        part = F.col("weight") * _part_of(self.sizes, F.col("x.tf"), F.col("x.dl"))
        return each.groupBy(F.col("x.key").alias(key)).agg(F.round(F.sum(part), 9).alias("score"))

    def candidates(self, query: str, limit: int, boosts: dict[str, float] | None = None, key: str = "path") -> DataFrame:
        """(zone, block, most, df): the blocks that a search for the best ``limit`` notes reads, the most that a note of them can
        score, and how many postings of the query's terms they have."""
        return self._candidates(self._weights(query, boosts), limit, key)

    def _candidates(self, weights: dict[tuple[str, str], float], limit: int, key: str) -> DataFrame:
        rows = self._weighed(self.blocks, weights) if weights else self.blocks.limit(0).withColumn("weight", F.lit(0.0))
        sums = rows.groupBy("zone", "block").agg(F.sum(F.col("weight") * F.col("top")).alias("most"), F.sum("df").alias("df"))
        best = sums.orderBy(F.desc("most"), "block").limit(limit).select("zone", "block").collect() if weights else []  # limit rows
        if len(best) < limit:
            return sums
        first = self._scored(rows.filter(self._among(best)), key).orderBy(F.desc("score")).limit(limit)
        reached = first.agg(F.min("score").alias("least")).first()["least"]
        return sums.filter(F.col("most") >= reached - SLACK)

    @staticmethod
    def _among(blocks: list) -> Column:
        return F.col("block").isin(*{b["block"] for b in blocks})

    def search(self, query: str, limit: int | None, key: str = "path", boosts: dict[str, float] | None = None) -> DataFrame:
        """(key, score) of the best notes, as ``bm25`` scores the words of the query; without a limit all that match."""
        weights = self._weights(query, boosts)
        if not weights or limit == 0:
            return self.blocks.select(F.element_at("notes", 1)["key"].alias(key), F.lit(0.0).alias("score")).limit(0)
        rows = self._weighed(self.blocks, weights)
        if limit is None:
            return self._scored(rows, key)
        wanted = self._candidates(weights, limit, key).select("zone", "block")
        listed = wanted.limit(LISTED + 1).collect()
        rows = rows.filter(self._among(listed)) if len(listed) <= LISTED else rows.join(wanted, ["zone", "block"], "left_semi")
        return self._scored(rows, key).orderBy(F.desc("score"), key).limit(limit)
