"""Vectorised text kernels: whole Arrow batches are tokenised and hashed with numpy, never word by word.

A chunk is a run of rows of at most ``CHUNK`` bytes of text (one longer text is a chunk by itself), which bounds the
memory of a Python worker whatever the batch size of the session. Arrays with a number for each byte are made for blocks
of ``CHUNK`` bytes, so that a very long text costs a few bytes for each of its own and some numbers for each of its words.
Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D``; a null text is an empty text.

A word of at most ``LONG`` bytes has the hash of a polynomial in an odd base modulo 2^64. Such sums can be equal for long
words of a special form, for which a thousand bytes are needed, so longer words go through a hash without one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK, LONG = 1 << 19, 64
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2, _STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int) -> np.ndarray:
    x = np.full(CHUNK + LONG + 1, base, U)
    x[0] = 1
    return np.cumprod(x, dtype=U)


#: The powers of the hash base and of its inverse modulo 2^64.
UP, DOWN = _powers(_BASE), _powers(_BASE_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * _M1
    h ^= h >> U(27)
    h *= _M2
    h ^= h >> U(31)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8), at


class Tokens:
    """The words of consecutive texts. ``first[i]:first[i+1]`` are the words of text ``i``; ``at`` are its byte bounds."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        data, self.at = data[at[0] : at[-1]], at - at[0]
        self.data = data = LOWER[data] if lower else data
        n = len(data)
        inside = ~WHITE[data]
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            edge = self.at[:-1][self.at[:-1] < self.at[1:]]
            begin[edge] = inside[edge]
            edge = self.at[1:][self.at[:-1] < self.at[1:]] - 1
            end[edge] = inside[edge]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out, block, lo = np.empty(len(self.starts), U), len(UP) - LONG - 1, 0
        while lo < len(out):
            base = self.starts[lo]
            hi = int(np.searchsorted(self.starts, base + block))
            part = self.data[base : base + block + LONG].astype(U)
            part += U(1)
            part *= UP[: len(part)]
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(part, out=sums[1:])
            s, e = self.starts[lo:hi] - base, np.minimum(self.ends[lo:hi] - base, len(part))
            out[lo:hi] = mix((sums[e] - sums[s]) * DOWN[s] + (e - s).astype(U))
            lo = hi
        for i in np.flatnonzero(self.ends - self.starts > LONG):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return out

    def bytes_per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(self.at[:-1], self.at[1:], strict=True)], np.int64)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` values, with ``k`` as part of the hash; a run that crosses texts is the caller's to skip."""
    if len(h) < k:
        return np.zeros(0, U)
    g = np.full(len(h) - k + 1, U(k))
    for j in range(k):
        g *= _STEP
        g += h[j : len(h) - k + 1 + j]
    return mix(g)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of rows of at most CHUNK bytes, or of one row."""
    data, at = text_buffer(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        yield lo, hi, data, at[lo : hi + 1]
        lo = hi


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column out of flat values and the length of each list."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def list_values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column without null elements, and its row offsets; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0))
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return np.asarray(column.flatten()), at
