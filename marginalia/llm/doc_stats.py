"""Counts and statistics of whole texts, chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .kernels import WHITE, Tokens, chunks, grams

REPEAT = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: The bytes that begin a character in UTF-8.
BEGINS = (np.arange(256) & 0xC0) != 0x80
_WHITE_BYTES = bytes(np.flatnonzero(WHITE).tolist())


@dataclass
class Counts:
    """Of the texts of a chunk: its tokens, the hashes of their words, and the base counts."""

    tokens: Tokens
    hashes: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_distinct: np.ndarray


def dup_lines(text: bytes) -> int:
    """How many lines with a word equal an earlier line of the text."""
    lines = [x for x in text.split(b"\n") if x.strip(_WHITE_BYTES)]
    return len(lines) - len(set(lines))


def repeat_words(h: np.ndarray, k: int = REPEAT) -> int:
    """How many words lie in a window of ``k`` words that the text has twice or more, the first included."""
    if len(h) <= k:
        return 0
    g = grams(h, k)
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    if not same.any():
        return 0
    hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    cover = np.zeros(len(h) + 1, np.int64)
    cover[hit] += 1
    cover[hit + k] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counted(column: pa.Array) -> Iterator[Counts]:
    for _, _, data, at in chunks(column):
        t = Tokens(data, at)
        h = t.hashes()
        words = [h[t.first[i] : t.first[i + 1]] for i in range(len(t.count))]
        text = t.data.tobytes()
        yield Counts(
            t, h,
            t.bytes_per_text(t.inside & BEGINS[t.data]), t.bytes_per_text(SYMBOLS[t.data]),
            np.array([dup_lines(text[t.at[i] : t.at[i + 1]]) for i in range(len(words))], np.int64),
            np.array([repeat_words(w) for w in words], np.int64), np.array([len(np.unique(w)) for w in words], np.int64),
        )


def _flags(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return out


_UPPER, _DIGIT = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("0123456789")
_LETTER = _UPPER | _flags("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
_PUNCT = ~(_LETTER | _DIGIT | WHITE) & (np.arange(256) > 0x20)
_SENTENCE, _BANG, _PIPE, _LINE, _WIDE = _flags(".?;:,"), _flags("!"), _flags("|"), _flags("\n"), np.arange(256) >= 0x80
STATISTICS = ("log_words", "log_bytes", "word_length", "word_length_spread", "upper", "digits", "punctuation", "symbols", "bangs", "pipes", "wide", "lines", "short_words", "long_words", "capitalised", "ends_in_sentence_mark", "ends_in_symbol", "punctuation_only", "distinct", "repeated", "dup_lines", "entropy")
FLOOR = 0.01


def statistics(c: Counts) -> np.ndarray:
    """A row of transformed statistics (STATISTICS) for each text; shares are log(FLOOR + share)."""
    t, n = c.tokens, c.tokens.count.astype(float)
    size = np.diff(t.at).astype(float)
    words, chars = np.maximum(n, 1), np.maximum(size, 1)

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(t.doc[flags], minlength=len(n)) / words

    length = (t.ends - t.starts).astype(float)
    mean = np.bincount(t.doc, length, len(n)) / words
    spread = np.sqrt(np.maximum(0, np.bincount(t.doc, length * length, len(n)) / words - mean * mean))
    share = lambda flags: t.bytes_per_text(flags[t.data]) / chars
    last, first = t.data[t.ends - 1], t.data[t.starts]
    marks = np.zeros(len(t.data) + 1, np.int32)
    np.cumsum(_PUNCT[t.data], out=marks[1:])
    only = (marks[t.ends] - marks[t.starts]) == length
    hist = np.stack([np.bincount(t.data[t.at[i] : t.at[i + 1]], minlength=256) for i in range(len(n))]) if len(n) else np.zeros((0, 256))
    p = hist / chars[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    shares = [share(x) for x in (_UPPER, _DIGIT, _PUNCT, SYMBOLS, _BANG, _PIPE, _WIDE, _LINE)] + [
        per_word(length <= 3), per_word(length >= 12), per_word(_UPPER[first]), per_word(_SENTENCE[last]), per_word((SYMBOLS | _BANG)[last]), per_word(only),
        c.n_distinct / words, c.n_repeat_words / words, c.n_dup_lines / np.maximum(t.bytes_per_text(_LINE[t.data]) + 1, 1),
    ]
    return np.column_stack([np.log1p(n), np.log1p(size), np.log1p(mean), np.log1p(spread), *[np.log(FLOOR + x) for x in shares], entropy])
