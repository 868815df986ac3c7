"""Vectorised tokenising and hashing of a batch of texts, as numpy arrays over one byte buffer.

A range hash is a polynomial over random 64-bit codes of the bytes (or words), taken from prefix
sums modulo 2**64 and then mixed, so any range of a buffer costs the same, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
CODES = _rng.integers(1, 2**64, size=256, dtype=np.uint64)
CODES2 = _rng.integers(1, 2**64, size=256, dtype=np.uint64)

#: ASCII white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of words made of digits, lower-case letters and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n + 1 of each at least."""
    have = _powers.get(0)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, BASE, U), np.full(size, pow(BASE, -1, 2**64), U)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
        if size <= 1 << 22:  # 64 MB; what longer texts need is not kept
            _powers[0] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * powers(len(codes))[0][: len(codes)], dtype=U, out=out[1:])
    return out


def ranges(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of [start, end)."""
    down = powers(len(pre))[1]
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


#: Bytes whose hashes are worked out at a time.
BLOCK = 1 << 18


def spans_hashed(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) of a buffer, for ascending ranges that don't overlap: block by block, whatever the buffer's length."""
    out = np.empty(len(start), U)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + BLOCK, side="right")))
        base = start[a]
        out[a:b] = ranges(prefix(CODES[buf[base : end[b - 1]]]), start[a:b] - base, end[a:b] - base)
        a = b
    return out


class Texts:
    """One byte buffer of several texts, each followed by a line feed. null: whether a text is null."""

    def __init__(self, column: pa.Array, fold: bool = False):
        column = column.cast(pa.large_string())
        self.n = len(column)
        self.null = column.is_null().to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        raw = np.frombuffer(column.buffers()[2], np.uint8) if self.n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
        lengths = np.where(self.null, 0, np.diff(offsets))
        self.start = np.zeros(self.n + 1, np.int64)
        np.cumsum(lengths + 1, out=self.start[1:])
        self.end = self.start[:-1] + lengths
        buf = np.full(int(self.start[-1]), 10, np.uint8)
        if not self.null.any():
            body = raw[offsets[0] : offsets[-1]]
            keep = np.ones(len(buf), bool)
            keep[self.end] = False
            buf[keep] = body
        else:
            for i in np.flatnonzero(lengths):
                buf[self.start[i] : self.end[i]] = raw[offsets[i] : offsets[i + 1]]
        self.buf = LOWER[buf] if fold else buf

    def words(self, wordy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of word bytes, and where each text's words begin (n + 1 numbers)."""
        inside = wordy[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        return starts, ends, np.searchsorted(starts, self.start)

    def slice(self, i: int, a: int, b: int) -> str:
        return self.buf[self.start[i] + a : self.start[i] + b].tobytes().decode("utf-8", "replace")


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each word, from where each text's words begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
