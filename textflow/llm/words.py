"""Words, hashes and counts of many texts at once, in numpy.

Texts of an Arrow column are joined into one byte buffer with a line feed
after each, so that words and lines never cross a document.  Words are maximal
runs of bytes other than x20 and x09-x0D; since UTF-8 never uses those bytes
inside a character, byte runs and code-point runs are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from textflow.llm import TaskCache

#: Bytes of text handled at once inside a task; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_PRIME, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_POWERS = TaskCache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse, at least n + 1 of each."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) <= n:
        size = (int(n) // 65536 + 1) * 65536
        have = powers(_PRIME, size), powers(_INVERSE, size)
        if size <= 8 * CHUNK_BYTES:
            _POWERS[0] = have
    return have


class RunHasher:
    """Equal byte runs of one buffer have equal 64-bit hashes."""

    def __init__(self, buf: np.ndarray):
        up, self._down = _powers(len(buf))
        self._sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * up[: len(buf)], dtype=np.uint64, out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))


@dataclass
class Texts:
    """Some texts and their words.  ``first``: the words of text i are
    first[i]:first[i + 1]; ``begin``: its bytes are begin[i]:begin[i + 1] - 1."""

    buf: np.ndarray
    begin: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.first))


def texts(values: list[bytes | None], lower: bool = False) -> Texts:
    values = [v or b"" for v in values]
    buf = np.frombuffer(b"\n".join(values) + b"\n", np.uint8)
    begin = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) + 1 for v in values], out=begin[1:])
    if lower:
        buf = _LOWER[buf]
    inside = np.empty(len(buf) + 1, np.int8)
    inside[0] = 0
    inside[1:] = ~_SEPARATOR[buf]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Texts(buf, begin, start, end, np.searchsorted(start, begin))


def chunks(column: pa.Array, most: int | None = None):
    """(first row, texts as bytes or None) for runs of rows of at most ``most``
    bytes, one row at least."""
    most = most or CHUNK_BYTES
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    ends, low = np.cumsum(size), 0
    while low < len(size):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield low, column.slice(low, high - low).cast(pa.large_binary()).to_pylist()
        low = high


def shingles(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, text by text, and where each
    text's begin (one more entry than texts).  A text with fewer words, but
    some, has its whole sequence as one."""
    word = RunHasher(t.buf)(t.start, t.end)
    n = np.diff(t.first)
    per = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(per, out=bounds[1:])
    owner = np.repeat(np.arange(len(n)), per)
    at = t.first[owner] + np.arange(bounds[-1]) - bounds[owner]
    weight = powers(0xD6E8FEB86659FD93, width)
    padded = np.append(word, np.zeros(width, np.uint64))
    total = np.full(len(at), width, np.uint64)
    for k in range(width):
        total += padded[at + k] * weight[k + 1]
    for i in np.flatnonzero((n > 0) & (n < width)):
        total[bounds[i]] = n[i] + (word[t.first[i]:t.first[i + 1]] * weight[1:n[i] + 1]).sum(dtype=np.uint64)
    return mix(total), bounds
