"""Substring deduplication by level-wise doubling.

Windows start at a short length and only those that documents share are extended to twice the length (at most the
window's), until the window is reached or no candidates survive. At the first length a document needs to offer only its
anchors: of every ``window - start + 1`` consecutive short windows the one with the least hash. Equal long windows have
equal anchors at equal offsets, so a long window whose anchor no other document has is shared with no document, and a
fifth of the positions stands for all. At the later lengths a window is a candidate if its anchor survived (second
length) or if its two end windows of the length before survived.

A length is one grouped minimum and maximum of document ids by window hash, pre-aggregated before the shuffle, and one
join that Spark may split; no group of equal windows is gathered. Texts move to their candidates once for each level after
the first and once to be cut. A Bloom filter of bounded size keeps back those without candidates; beyond some ten million
documents with candidates it lets all texts pass, and they are shuffled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Tokens, U, chunks, grams, list_values, lists, signed
from .storage import Bloom, Work

WINDOW, START = 13, 7


def lengths(window: int, start: int) -> list[int]:
    """The window lengths of the levels: doubling from ``start`` up to ``window``."""
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def anchors(g: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` consecutive hashes the place of its least one (the first of equals)."""
    if len(g) < span:
        return np.zeros(0, np.int64)
    place, width = np.arange(len(g)), 1
    while 2 * width <= span:  # least of width hashes, doubled
        a, b = place[:-width], place[width:]
        place = np.where(g[b] < g[a], b, a)
        width *= 2
    a, b = place[: len(g) - span + 1], place[span - width : len(g) - width + 1]
    return np.where(g[b] < g[a], b, a)


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    for _, _, data, at in chunks(column):
        tokens = Tokens(data, at)
        h = tokens.hashes()
        for i, n in enumerate(tokens.count):
            yield h[tokens.first[i] : tokens.first[i] + n]


def _offer(window: int, start: int):
    """Per text: its number of words, the digest of all of them, and the distinct hashes of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                n, found = [], []
                for h in _words(part.column(1)):
                    n.append(len(h))
                    g = grams(h, start)
                    found.append(np.unique(g[anchors(g, window - start + 1)]))
                digests = [hashlib.sha256(b" ".join(t.encode().split())).hexdigest() if t else hashlib.sha256().hexdigest() for t in part.column(1).to_pylist()]
                flat = np.concatenate(found) if found else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(n, np.int64)), pa.array(digests, pa.string()), lists(signed(flat), [len(x) for x in found])], ["doc_id", "n_words", "sha", "hashes"])

    return run


def _extend(window: int, start: int, before: int, length: int):
    """Per text the distinct hashes of its candidate windows of ``length``; ``hashes`` are its survivors of ``before``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                kept, at = list_values(part.column(2))
                found = []
                for i, h in enumerate(_words(part.column(1))):
                    short, long = grams(h, before), grams(h, length)
                    alive = np.isin(short, kept[at[i] : at[i + 1]].view(U))
                    if before == start and len(long):  # survivors are anchors only
                        whole = alive[anchors(short, window - start + 1)] if len(h) >= window else np.zeros(0, bool)
                        # a window of this length is a candidate if it lies in a whole window with a surviving anchor
                        cover = np.zeros(len(long) + 1, np.int64)
                        begin = np.flatnonzero(whole)
                        np.add.at(cover, begin, 1)
                        np.add.at(cover, begin + (window - length) + 1, -1)
                        candidate = np.cumsum(cover[:-1]) > 0
                    else:
                        candidate = alive[: len(long)] & alive[length - before : length - before + len(long)]
                    found.append(np.unique(long[candidate]))
                flat = np.concatenate(found) if found else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays([part.column(0), lists(signed(flat), [len(x) for x in found])], ["doc_id", "hashes"])

    return run


def _remove(window: int):
    """Per text the words left and their digest; ``hashes`` are the windows of the text to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drop, at = list_values(batch.column(2))
            n, digests, whole = [], [], []
            texts = batch.column(1)
            for i, h in enumerate(_words(texts)):
                hit = np.flatnonzero(np.isin(grams(h, window), drop[at[i] : at[i + 1]].view(U)))
                cover = np.zeros(len(h) + 1, np.int64)
                cover[hit] += 1
                cover[hit + window] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                words = (texts[i].as_py() or "").encode().split()
                n.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest())
                whole.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.string()), pa.array(n, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "sha", "n_removed", "kept_sha256"])

    return run


def _shared(rows: DataFrame, later: bool = False) -> DataFrame:
    """Of (doc_id, hashes) the hashes that more than one document has, by document; with ``later`` only for documents
    other than the first that has it."""
    each = rows.filter("doc_id is not null").select("doc_id", F.explode("hashes").alias("h"))
    span = each.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h", "lo")
    kept = each.join(span, "h")
    kept = kept.filter("doc_id > lo") if later else kept
    return kept.groupBy("doc_id").agg(F.collect_set("h").alias("hashes"))


def _with_hashes(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, text, hashes) of the documents in ``marks`` (doc_id, hashes)."""
    bloom = Bloom(marks.select("doc_id"), "doc_id")
    words = bloom.words

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, _ = list_values(batch.column(2))
            yield batch.select([0, 1]).filter(pa.array(Bloom.passing(words.value, places)))

    some = docs.filter("doc_id is not null").select("doc_id", "text", bloom.places("doc_id").alias("places"))
    return some.mapInArrow(pass_on, "doc_id bigint, text string").join(marks, "doc_id")


def substring_dedup(docs: DataFrame, window: int = WINDOW, start: int = START) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of ``docs`` (doc_id, text; other columns are ignored).

    Removed is each word in a window of ``window`` words that also starts in a document with a smaller doc_id; windows
    are judged on the input. Texts of fewer words lose none; null and white texts have no words. Rows without a doc_id
    lose nothing and make no other document lose words. Rows that share a doc_id count as one document, and each gets
    its row. A very long text is a row like others; its windows are made by one task. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Work(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = lengths(window, start)
    offered = work.cut(docs.mapInArrow(_offer(window, levels[0]), "doc_id bigint, n_words bigint, sha string, hashes array<bigint>"), "offered")
    alive = work.cut(_shared(offered.select("doc_id", "hashes"), later=levels[0] == window), "level")
    # what the result needs of these rows is small; their hashes need no disk any longer
    kept_whole = work.cut(offered.select("doc_id", "n_words", "sha"), "whole")
    work.drop(offered)
    for before, length in zip(levels, levels[1:]):
        if alive.isEmpty():
            break
        wider = _with_hashes(docs, alive).mapInArrow(_extend(window, levels[0], before, length), "doc_id bigint, hashes array<bigint>")
        wider, seen = work.cut(wider, "wider"), alive
        alive = work.cut(_shared(wider, later=length == window), "level")
        work.drop(wider, seen)
    work.keep(kept_whole, alive)
    changed = _with_hashes(docs, alive).mapInArrow(_remove(window), "doc_id bigint, sha string, n_removed bigint, kept_sha256 string").dropDuplicates(["doc_id", "sha"])
    out = kept_whole.join(changed, ["doc_id", "sha"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
