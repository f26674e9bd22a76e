"""Vector functions: cosine as a Column expression, and the deterministic harmonic token embedding.

The embedding reads a token's code points as digits of base 65536 modulo 2^64, so that only the last four of its first
64 count, and projects that number on each of the first PRIMES primes p as sine and cosine of 2*pi*(n mod p)/p. A text
is the normalised mean over its tokens; a text without tokens is the zero vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import tokenize

VECTOR = T.ArrayType(T.DoubleType())
PRIMES, READ = 192, 64
DIMENSION = 2 * PRIMES
#: Texts that are taken out of a batch, and tokens of a text that are made into vectors, at once.
TEXTS, TOKENS = 16, 1024


def first_primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found if p * p <= k):
            found.append(k)
        k += 1
    return found


MODULI = first_primes(PRIMES)
_M = np.array(MODULI, np.uint64)
#: Where a modulus begins in the tables of sines and cosines of all remainders.
_BEGIN = np.concatenate([[0], np.cumsum(MODULI)[:-1]])
_TURN = np.concatenate([np.arange(m) * (2 * math.pi / m) for m in MODULI])
_SIN, _COS = np.sin(_TURN), np.cos(_TURN)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different lengths or without a direction."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def normalise(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def to_blob(vec: Column) -> Column:
    """A vector as little-endian 32-bit floats, in Arrow batches."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes()), T.BinaryType())(vec)


def from_blob(blob: Column) -> Column:
    """The vector of little-endian 32-bit floats, in Arrow batches."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else np.frombuffer(x, "<f4").tolist()), T.ArrayType(T.FloatType()))(blob)


def token_halves(token: Column) -> tuple[Column, Column]:
    """The upper and lower 32 bits of a token's number, as longs."""
    codes = F.transform(F.split(F.right(F.left(token, F.lit(READ)), F.lit(4)), ""), lambda c: F.ascii(c).cast("long"))
    codes = F.filter(codes, lambda c: c > 0)
    c = [F.coalesce(F.get(F.reverse(codes), F.lit(k)), F.lit(0).cast("long")) for k in range(4)]
    low, high, word = c[1] * 65536 + c[0], c[3] * 65536 + c[2], 1 << 32
    return (high + F.shiftright(low, 32)) % word, low % word


def token_number(token: Column) -> Column:
    """A token's number as decimal(20, 0), as it may reach 2^64."""
    high, low = token_halves(token)
    return (high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + low).cast("decimal(20,0)")


def token_vector(token: Column) -> Column:
    """A token's vector out of built-in functions only, sine and cosine in turn."""
    high, low = token_halves(token)
    parts = []
    for m in MODULI:
        turn = (((high % m) * ((1 << 32) % m) + low % m) % m) * F.lit(2 * math.pi / m)
        parts += [F.sin(turn), F.cos(turn)]
    return F.array(*parts)


def _number(token: str) -> int:
    n = 0
    for c in token[:READ][-4:]:
        n = (n << 16) + ord(c)
    return n & 0xFFFFFFFFFFFFFFFF


def token_matrix(tokens) -> np.ndarray:
    """The vectors of tokens, a row each."""
    at = (np.array([_number(t) for t in tokens], np.uint64)[:, None] % _M).astype(np.int64) + _BEGIN
    return np.stack([_SIN[at], _COS[at]], axis=2).reshape(len(at), DIMENSION)


def embed_tokens(tokens) -> np.ndarray:
    """The vector of a list of tokens."""
    if not len(tokens):
        return np.zeros(DIMENSION)
    mean = sum(token_matrix(tokens[k : k + TOKENS]).sum(axis=0) for k in range(0, len(tokens), TOKENS)) / len(tokens)
    size = math.sqrt(mean @ mean)
    return mean / size if size > 0 else mean


def _embed(tokens: pa.Array) -> pa.Array:
    out = np.zeros((len(tokens), DIMENSION))
    for at in range(0, len(tokens), TEXTS):
        for i, t in enumerate(tokens.slice(at, TEXTS).to_pylist()):
            if t:
                out[at + i] = embed_tokens(t)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * DIMENSION), pa.array(out.ravel()))


def embed(text: Column) -> Column:
    """The vector of a text, in Arrow batches: measured faster than the built-in form, which token_vector keeps for checks."""
    return F.arrow_udf(_embed, VECTOR)(tokenize(text))


def embed_text(text: str) -> np.ndarray:
    """The vector of a query on the driver."""
    import re

    return embed_tokens([t for t in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if t])


class Embedder:
    """What an embedder offers: its name, its dimension, and vectors of a column and of a query."""

    name, dimension = "htp", DIMENSION

    def matrix(self, tokens: list[str]) -> np.ndarray:
        return token_matrix(tokens)

    def nearest_words(self, tokens: list[str], floor: float, limit: int) -> list[tuple[str, float]]:
        """The distinct words whose cosine to the mean of all is over a floor, nearest first."""
        words = sorted(set(tokens))
        if not words:
            return []
        rows, times = self.matrix(words), np.array([tokens.count(w) for w in words] if len(tokens) < 64 else np.unique(tokens, return_counts=True)[1], float)
        whole, size = times @ rows, np.sqrt((rows * rows).sum(axis=1))
        score = np.round(rows @ whole / np.maximum(size * math.sqrt(whole @ whole), 1e-12), 9)
        order = np.lexsort((np.arange(len(words)), -score))
        return [(words[i], float(score[i])) for i in order if score[i] > floor][:limit]

    def column(self, text: Column) -> Column:
        return embed(text)

    def query(self, text: str) -> np.ndarray:
        return embed_text(text)


class TableEmbedder(Embedder):
    """Static token vectors from a table of token -> vector; a text is the normalised mean over its known tokens.

    The table is a vocabulary file of bounded size and goes to the workers with the function.
    """

    def __init__(self, table: dict[str, list[float]], name: str = "table", unit: bool = True):
        sizes = {len(v) for v in table.values()}
        if len(sizes) != 1:
            raise ValueError("all vectors of a table must have one dimension")
        self.table, self.name, self.unit, self.dimension = {k: np.asarray(v, float) for k, v in table.items()}, name, unit, sizes.pop()

    def matrix(self, tokens: list[str]) -> np.ndarray:
        return np.array([self.table.get(t, np.zeros(self.dimension)) for t in tokens]).reshape(-1, self.dimension)

    def _mean(self, tokens: Iterator[str]) -> np.ndarray:
        rows = [self.table[t] for t in tokens if t in self.table]
        mean = np.mean(rows, axis=0) if rows else np.zeros(self.dimension)
        size = math.sqrt(mean @ mean)
        return mean / size if self.unit and size > 1e-12 else mean

    def column(self, text: Column) -> Column:
        own = self

        def run(tokens: pd.Series) -> pd.Series:
            return pd.Series([own._mean([] if t is None else t) for t in tokens])

        return F.pandas_udf(run, VECTOR)(tokenize(text))

    def query(self, text: str) -> np.ndarray:
        import re

        return self._mean([t for t in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if t])


class SubwordEmbedder(Embedder):
    """Static vectors of subwords: a text is the normalised mean over the rows of its token ids, and a word is the mean over
    the subwords it is made of. Tokenizer and rows are files of a model, of bounded size, and go to the workers."""

    STARTS, CONTINUED = ("\u2581", "\u0120"), "##"

    def __init__(self, rows: np.ndarray, tokenizer: str, name: str = "subword", unit: bool = True):
        """``tokenizer`` is the text of a tokenizer.json."""
        self.rows, self.text, self.name, self.unit, self.dimension = np.asarray(rows, float), tokenizer, name, unit, rows.shape[1]
        self._loaded = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    @property
    def tokenizer(self):
        if self._loaded is None:
            from tokenizers import Tokenizer

            self._loaded = Tokenizer.from_str(self.text)
        return self._loaded

    def query(self, text: str) -> np.ndarray:
        ids = [i for i in self.tokenizer.encode(text, add_special_tokens=False).ids if i < len(self.rows)]
        mean = self.rows[ids].mean(axis=0) if ids else np.zeros(self.dimension)
        size = math.sqrt(mean @ mean)
        return mean / size if self.unit and size > 1e-12 else mean

    def column(self, text: Column) -> Column:
        own = self
        return F.pandas_udf(lambda texts: pd.Series([own.query(t or "") for t in texts]), VECTOR)(text)

    def words(self, text: str) -> list[tuple[str, list[int]]]:
        """The words of a text with the ids of their subwords: a subword begins a word if it is marked so or if the tokenizer
        has split the text before it."""
        found, before = self.tokenizer.encode(text, add_special_tokens=False), object()
        out: list[tuple[str, list[int]]] = []
        for token, i, of in zip(found.tokens, found.ids, found.word_ids, strict=True):
            if token.startswith(self.STARTS) or of != before or not out:
                out.append((token.lstrip("".join(self.STARTS)).removeprefix(self.CONTINUED).lower(), [i]))
            else:
                out[-1] = (out[-1][0] + token.removeprefix(self.CONTINUED).lower(), [*out[-1][1], i])
            before = of
        return out

    def matrix(self, tokens: list[str]) -> np.ndarray:
        return np.array([self.query(t) for t in tokens]).reshape(-1, self.dimension)

    def keywords(self, text: str, floor: float, limit: int) -> list[tuple[str, float]]:
        """The words of a text whose cosine to it is over a floor, nearest first; marks of special tokens and single letters are none."""
        whole, score = self.query(text), {}
        for word, ids in self.words(text):
            ids = [i for i in ids if i < len(self.rows)]
            if len(word.encode()) >= 2 and not word.startswith(("[", "<")) and word not in score and ids:
                mean = self.rows[ids].mean(axis=0)
                size = math.sqrt((mean @ mean) * (whole @ whole))
                if mean.any():
                    score[word] = round(float(mean @ whole / size), 9) if size else 0.0
        return sorted(((w, s) for w, s in score.items() if s > floor), key=lambda x: (-x[1], x[0]))[:limit]


def create_embedder(table: dict[str, list[float]] | None = None) -> Embedder:
    """The table's embedder if there is a table, else the harmonic one."""
    return TableEmbedder(table) if table else Embedder()
