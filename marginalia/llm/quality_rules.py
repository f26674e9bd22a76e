"""Quality rules: base rules on counts, and a logistic regression on hashed word and character n-grams.

The regression is fitted on the driver on at most ``SAMPLE`` labelled rows with at most ``MOST_FEATURES`` features in all
(documented bounds; the rows come in the order of a hash of their ids), four fifths of them for the weights and one fifth
to calibrate its probability (Platt's sigmoid). Scoring runs in Arrow batches; the weights, of fixed size, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .doc_stats import BEGINS, Counts, counted
from .kernels import CHUNK, U, grams, lists, list_values, mix
from .labels import binary_labels, sample
from .storage import Work

SAMPLE, MOST_FEATURES, DIMENSIONS, EPOCHS, RATE = 4000, 1 << 24, 1 << 18, 8, 0.5
CHARACTERS = 4
THRESHOLD, LEAST_WORDS, MOST_REPEATED = 0.5, 20, 30
_SALTS = (U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179), U(0x3C6EF372FE94F82B))
KINDS, _STEP = len(_SALTS), U(0xD6E8FEB86659FD93)


def _places(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    return (mix(x ^ salt) & U(DIMENSIONS - 1)).astype(np.int64)


def hashed(c: Counts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, feature of each occurrence, text it is in) for words, word pairs and runs of four characters; the runs in
    blocks, as there are more of them than words."""
    t, h = c.tokens, c.hashes
    inside = t.doc[1:] == t.doc[:-1]
    yield 0, _places(h, _SALTS[0]), t.doc
    yield 1, _places(grams(h, 2)[inside], _SALTS[1]), t.doc[1:][inside]
    begins = np.flatnonzero(BEGINS[t.data])
    for lo in range(0, len(begins), CHUNK):
        at = begins[lo : lo + CHUNK + CHARACTERS - 1]
        end = begins[lo + len(at)] if lo + len(at) < len(begins) else len(t.data)
        points = np.frombuffer(t.data[at[0] : end].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(U)
        of, n = np.searchsorted(t.at[1:], at, "right"), max(len(at) - CHARACTERS + 1, 0)
        run = np.zeros(n, U)
        for j in range(CHARACTERS):
            run = run * _STEP + points[j : n + j]
        whole = of[:n] == of[CHARACTERS - 1 : CHARACTERS - 1 + n]
        yield 2, _places(run[whole], _SALTS[2]), of[:n][whole]


def margins(c: Counts, weights: np.ndarray, bias: float) -> np.ndarray:
    """The linear score of each text: the sum over the three kinds of features of their mean weight."""
    n = len(c.tokens.count)
    sums, sizes = np.zeros((KINDS, n)), np.zeros((KINDS, n))
    for kind, feature, of in hashed(c):
        sums[kind] += np.bincount(of, weights[feature], n)
        sizes[kind] += np.bincount(of, minlength=n)
    return bias + (sums / np.maximum(sizes, 1)).sum(axis=0)


def _features_of(c: Counts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct features of each text with their values: a kind's occurrences share a weight of one."""
    n = len(c.tokens.count)
    kinds, features, texts = ([], [], [])
    for kind, feature, of in hashed(c):
        key, times = np.unique(of * DIMENSIONS + feature, return_counts=True)
        kinds.append(np.full(len(key), kind)), features.append(key), texts.append(times)
    kind, key, times = map(np.concatenate, (kinds, features, texts))
    of = key // DIMENSIONS
    value = times / np.bincount(kind * n + of, times, KINDS * n)[kind * n + of]
    distinct, at = np.unique(key, return_inverse=True)
    value, first = np.bincount(at, value, len(distinct)), np.searchsorted(distinct // DIMENSIONS, np.arange(n + 1))
    for i in range(n):
        yield distinct[first[i] : first[i + 1]] % DIMENSIONS, value[first[i] : first[i + 1]]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, n, sign, places, values): the features of a text, their number, and a hash that orders equal ids."""
    seen: set[tuple] = set()
    for batch in batches:
        at, kept = 0, []
        for c in counted(batch.column(1)):
            for u, v in _features_of(c):
                sign = int((mix(u.astype(U)) * v.astype(np.float32).view(np.uint32).astype(U)).sum(dtype=U) >> U(1))
                own = (batch.column(0)[at].as_py(), sign)
                if own not in seen:  # repeated rows are one row a partition, and later one in all
                    kept.append((at, len(u), sign, u.astype(np.int32), v.astype(np.float32)))
                    seen.add(own)
                at += 1
            if len(seen) > SAMPLE:
                seen.clear()
        rows = pa.array([k[0] for k in kept], pa.int64())
        flat = [np.concatenate([k[j] for k in kept]) if kept else np.zeros(0, kind) for j, kind in ((3, np.int32), (4, np.float32))]
        n = [k[1] for k in kept]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(n, pa.int64()), pa.array([k[2] for k in kept], pa.int64()), lists(flat[0], n), lists(flat[1], n)], ["doc_id", "label", "n", "sign", "places", "values"])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the sigmoid of a*x + b that fits labels best, with Platt's smoothed targets; the identity for one class."""
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    if not ones or not zeros:
        return 1.0, 0.0
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 0.0, float(np.log((ones + 1) / (zeros + 1)))
    scale = float(np.std(x)) or 1.0
    z = x / scale
    for _ in range(50):
        p = sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([(z * (p - target)).sum() + 1e-3 * a, (p - target).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a / scale, b


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, a, b) from the labelled documents; without two classes every text scores like the one there is."""
    work = Work(docs.sparkSession, "rules")
    chosen = F.broadcast(sample(binary_labels(labels, "quality"), most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    rows = work.cut(rows.mapInArrow(_features, "doc_id bigint, label int, n bigint, sign bigint, places array<int>, values array<float>"), "features")
    order = [F.xxhash64("doc_id"), "doc_id", "sign"]
    first = rows.select("doc_id", "sign", "n").distinct().orderBy(*order).limit(most).toArrow()
    fit = int((np.cumsum(np.asarray(first["n"], dtype=np.int64)) <= MOST_FEATURES).sum())
    kept = F.broadcast(docs.sparkSession.createDataFrame(first.slice(0, fit).select(["doc_id", "sign"]).to_pandas(), "doc_id bigint, sign bigint"))
    got = rows.join(kept, ["doc_id", "sign"], "left_semi").dropDuplicates(["doc_id", "sign"]).toArrow().sort_by([("doc_id", "ascending"), ("sign", "ascending")])
    work.drop(rows)
    y = np.asarray(got["label"], dtype=float)
    flat, at = list_values(got["places"])
    value, _ = list_values(got["values"])
    weights, squares = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    if not len(y) or y.min() == y.max():
        return weights, (0.0 if not len(y) else 4.0 * (2 * y[0] - 1)), 1.0, 0.0
    held = np.arange(len(y)) % 5 == 4
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(np.flatnonzero(~held)):
            f, v = flat[at[i] : at[i + 1]], value[at[i] : at[i + 1]]
            g = (sigmoid(weights[f] @ v + bias) - y[i]) * v
            squares[f] += g * g
            weights[f] -= RATE * g / np.sqrt(squares[f])
    x = np.array([weights[flat[at[i] : at[i + 1]]] @ value[at[i] : at[i + 1]] + bias for i in np.flatnonzero(held)])
    return weights, bias, *platt(x, y[held])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, a, b = model.value
        for batch in batches:
            n, chars, symbols, lines, repeated, p = [], [], [], [], [], []
            for c in counted(batch.column(1)):
                n.append(c.tokens.count), chars.append(c.word_chars), symbols.append(c.n_symbols), lines.append(c.n_dup_lines), repeated.append(c.n_repeat_words)
                p.append(sigmoid(a * margins(c, weights, bias) + b))
            columns = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (n, chars, symbols, lines, repeated)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(np.concatenate(p) if p else np.zeros(0))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) of each row.

    A text fails the base rules with fewer than 20 words or with over 30 % of its words in repeated windows; else it is
    kept if the calibrated probability of good quality reaches ``threshold``. Null and white texts have no words and
    fail. Repeated rows and rows without a doc_id are scored like others. Unlabelled tables keep what passes the base
    rules. A very long text is judged as a whole, its characters in blocks. An empty table gives an empty result. Columns
    other than doc_id, text and quality are ignored.
    """
    weights, bias, a, b = train(docs, labels, most)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias, a, b))
    out = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = out.mapInArrow(_score(model), f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, probability double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("probability") >= threshold)).alias("kept"), "probability")
