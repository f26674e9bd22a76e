"""Phrase collocation mining.

The n-grams of the pieces of texts are exploded into rows, counted a stretch of text at a time, and added up by language in a
hash aggregation: words and pairs of words, then longer ones by one word more at a time, those of which both parts of a word
less are frequent, as no other can be. What is frequent enough is a small table; each way to cut a phrase joins the counts of its two parts and is scored in decimals,
one-word extensions that take most of a phrase's occurrences drop it by an anti-join, and windows rank what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import Work, join_hot

MAX_N, LEAST, SCALE, SHARE, BEST = 3, 10, 1_000_000, 50, 2000
UNKNOWN = "und"
#: Groups that a language's phrases are ranked in first, and second, so that no task ranks more than some thousand rows a group.
SPREAD = (256, 16)
#: Bytes of text whose phrases are counted together before they become rows.
CHUNK = 1 << 22
#: Rows that are sent on at once.
SENT = 1 << 15
#: Bits of the filter of frequent phrases at most (32 MB), and places that a phrase has in it.
MAX_BITS, HASHES = 1 << 28, 3
STOP, GAP, TAB = b".", b" ", "\t"
#: Lower case for A-Z, one stop for all that ends a piece, one gap for what parts words.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\n\x0b\x0c\r" + b"\t", b"abcdefghijklmnopqrstuvwxyz" + STOP * 10 + GAP)


def _segments(text: bytes, chunk: int) -> Iterator[bytes]:
    """A text in which only stops and gaps are left, in stretches of some ``chunk`` bytes that end with a piece."""
    text, at = text.translate(TABLE), 0
    while at < len(text):
        end = text.find(STOP, at + chunk)
        end = end + 1 if end >= 0 else len(text)
        yield text[at:end]
        at = end


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of phrases by those of what stands before their last word and of that word."""
    h = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    return h ^ (h >> np.uint64(32))


def _hashes(values: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in values], np.uint64)


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(bits) for i in range(HASHES)], axis=1).astype(np.int64)


def _count(langs: list[str], segments: list[bytes], lowest: int, highest: int, known_words: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(key, a): the phrases of ``lowest`` to ``highest`` words of each language with their counts; with 1 the empty phrase too. With
    a filter only those of ``highest`` words whose two parts of one word less may be in it."""
    split = [pa.array((x.replace(STOP, b" . ") + b" .").split(), pa.binary()) for x in segments]
    named, lang = np.unique(np.array(langs, object), return_inverse=True)
    coded = pa.chunked_array(split, pa.binary()).combine_chunks().dictionary_encode()
    words, code, of = coded.dictionary, np.asarray(coded.indices).astype(np.int64), np.repeat(lang.astype(np.int64), [len(x) for x in split])
    del split, coded
    word = code != words.index(pa.scalar(STOP, pa.binary())).as_py()
    keys = pa.array([x.encode() + TAB.encode() for x in named], pa.binary())
    hashes = [_hashes([x.encode() for x in named]), _hashes(words.to_pylist())] if known_words is not None else []

    def rows(keys: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), SENT):
            yield pa.RecordBatch.from_arrays([keys[i : i + SENT].cast(pa.string()), pa.array(counts[i : i + SENT].astype(np.int64))], ["key", "a"])

    if lowest == 1:
        yield from rows(keys, np.bincount(of[word], minlength=len(named)))
    valid, gap = word, b""
    for n in range(1, highest + 1):
        at = np.flatnonzero(valid[: len(code) - n + 1] & word[n - 1 :])
        if n == highest and known_words is not None:
            p = _bits(hashes[0], 64 * len(known_words))
            met = ((known_words[p >> 6] >> (p & 63)) & 1).all(axis=1)
            at = at[met[of[at]] & met[of[at + 1]]]
        found, kinds = pd.factorize(of[at] * len(words) + code[at + n - 1])
        before, last = kinds // len(words), kinds % len(words)
        keys = pc.binary_join_element_wise(keys.take(pa.array(before)), words.take(pa.array(last)), gap)
        if n >= lowest:
            yield from rows(keys, np.bincount(found, minlength=len(kinds)))
        hashes[:1] = [_mixed(hashes[0][before], hashes[1][last])] if hashes else []
        of, valid, gap = np.zeros(len(code), np.int64), np.zeros(len(code), bool), GAP
        of[at], valid[at] = found, True


def _filter_of(frequent: DataFrame) -> np.ndarray:
    """A Bloom filter of phrases (lang, phrase), of MAX_BITS at most: with more phrases than it can tell apart it lets more pass."""
    bits = min(MAX_BITS, max(1 << 16, 1 << (16 * frequent.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = _hashes([lang.encode()])
                for w in phrase.encode().split(GAP):
                    h = _mixed(h, _hashes([w]))
                out.append(h)
            p = _bits(np.concatenate(out), bits).ravel() if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array(np.left_shift(np.int64(1), p & 63))], ["w", "b"])

    got = frequent.select("lang", "phrase").mapInArrow(run, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[np.asarray(got["w"])] = np.asarray(got["b"])
    return filled


def count_phrases(docs: DataFrame, lowest: int, highest: int, known: np.ndarray | None = None, chunk: int = CHUNK) -> DataFrame:
    """(lang, phrase, a): how often each phrase of so many words occurs; with a filter of the frequent shorter phrases, those that
    can be frequent. From 1 word on the empty phrase counts all words. Texts become rows of phrases, already counted for
    some ``chunk`` bytes; one hash aggregation by language and phrase, which are one key while they are moved, adds them up."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)), F.coalesce(F.col("text").cast("string"), F.lit("")))
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, held, size = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                for x in _segments(text.as_buffer().to_pybytes(), chunk):
                    langs.append(lang.as_py())
                    held.append(x)
                    size += len(x)
                    if size >= chunk:
                        yield from _count(langs, held, lowest, highest, sent.value)
                        langs, held, size = [], [], 0
        if held:
            yield from _count(langs, held, lowest, highest, sent.value)

    counted = rows.mapInArrow(run, "key string, a bigint").groupBy("key").agg(F.sum("a").alias("a"))
    lang = F.expr(f"left(key, char_length(key) - 1 - char_length(substring_index(key, '{TAB}', -1)))")
    return counted.select(lang.alias("lang"), F.substring_index("key", TAB, -1).alias("phrase"), "a")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)) in decimals of 38 digits, which hold counts below 10^15."""
    d = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (d(a) * d(a)), d(left) * d(right))


def _first(rows: DataFrame, most: int, groups: list[Column]) -> DataFrame:
    """``rows`` that are among the first ``most`` of their group, with their ``rank``."""
    order = W.partitionBy("lang", *groups).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)


def mine_phrases(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, best: int = BEST, chunk: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of each language of ``docs`` (lang, text), of 2 to ``max_n``
    words that occur ``least`` times or more.

    ``a``, ``l`` and ``r`` count the phrase and the parts of its lowest-scoring cut (of equal ones the shortest first part), ``n`` all
    words of the language. A phrase is dropped if ``share`` per cent of its occurrences or more are those of one longer
    phrase: then they are also those of a phrase one word longer, which is all that must be looked at. Ties are ranked by
    count and phrase. A null text has no words, a null language is ``und``; repeated rows count again; a very long text is
    cut into pieces where it is read; other columns aren't read. An empty table gives an empty result.

    Frequent parts are in the table of frequent phrases themselves. Parts that many phrases have are joined in place, the
    rest by a shuffle; ranks are taken within groups of a language before whole languages are ranked.
    """
    work = Work(docs.sparkSession, "phrases")
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    kept_counts = lambda counts, name: work.cut(counts.filter((F.col("a") >= least) | (F.col("phrase") == "")).withColumn("words", words), name)
    counted = kept_counts(count_phrases(docs, 1, min(max_n, 2), chunk=chunk), "counted")
    for n in range(3, max_n + 1):
        counted = counted.unionByName(kept_counts(count_phrases(docs, n, n, _filter_of(counted.filter(f"words = {n - 1}")), chunk), f"of-{n}"))
    frequent, totals = counted.filter(f"words > 0 and a >= {least}"), counted.filter("words = 0").select("lang", F.col("a").alias("n"))
    longer = frequent.filter("words > 1")

    joined = lambda at, n: F.array_join(F.slice(F.split("phrase", " "), at, n), " ")
    cut = longer.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = work.cut(cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right")), "cuts")
    total = cut.count()
    for part, count in (("left", "l"), ("right", "r")):
        uses = cut.groupBy("lang", part).agg(F.count("*").alias("uses"))
        known = frequent.select("lang", F.col("phrase").alias(part), F.col("a").alias(count)).join(uses, ["lang", part])
        cut = join_hot(cut, known, ["lang", part], "uses", total)
    scored = cut.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")

    inner = frequent.filter("words > 2").select("lang", F.explode(F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("phrase"), F.col("a").alias("most"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    dropped = longer.join(inner, ["lang", "phrase"]).filter(100 * F.col("most") >= share * F.col("a")).select("lang", "phrase")
    kept = lowest.join(dropped, ["lang", "phrase"], "left_anti")

    for groups in SPREAD:
        kept = _first(kept, best, [F.pmod(F.xxhash64("phrase"), F.lit(groups))])
    kept = _first(kept, best, [])
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
