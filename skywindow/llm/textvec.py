"""Words and word shingles of many texts at once, in numpy.

Two word forms: ``raw`` words are runs of anything but ASCII white space (0x20, 0x09-0x0D); ``plain`` words, used for
near-duplicate work, are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text, so that case
and punctuation don't hide a copy.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat

U = np.uint64
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BREAK = np.ones(256, bool)
BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, other for each seed."""
    x = (x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))).astype(U)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def spans(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word among the bytes, and the index of each text's first word (one more at the end)."""
    inside = ~breaks[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offs[offs < len(data)]
    first[at] = inside[at]
    at = offs[offs > 0] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same in every process. Spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, U)
    size = ends - starts
    at = np.repeat(np.cumsum(size) - size, size)
    rel = np.arange(len(at)) - at
    powers = np.cumprod(np.full(int(size.max()), _BASE, U))
    bytes_ = data[np.repeat(starts, size) + rel].astype(U) + U(1)
    return mix(np.add.reduceat(bytes_ * powers[rel], np.cumsum(size) - size))


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span of bytes, the same for equal ones alone."""
    size = ends - starts
    at = np.cumsum(size) - size
    packed = data[np.repeat(starts, size) + np.arange(int(size.sum())) - np.repeat(at, size)]
    spans_ = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(at, len(packed)).astype(np.int64)), pa.py_buffer(packed)])
    return np.asarray(spans_.dictionary_encode().indices).astype(np.int64)


class Words:
    """Plain or raw words of a slice of texts: ``start``/``end`` bytes, ``hash``, and ``first`` word index of each text."""

    def __init__(self, texts: pa.Array, plain: bool = True):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if plain:
            texts = pc.utf8_lower(texts)
        self.data, self.offs = flat(texts)
        self.start, self.end, self.first = spans(self.data, self.offs, BREAK if plain else SPACE)
        self.count = np.diff(self.first)

    @cached_property
    def hash(self) -> np.ndarray:
        return span_hash(self.data, self.start, self.end)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``k``-word shingles in order, and the index of each text's first (one more at the end).

        A text with 1 to k - 1 words has one shingle, of all its words; a text without words has none.
        """
        n = len(self.hash)
        if not n:
            return np.zeros(0, U), np.zeros(len(self.count) + 1, np.int64)
        doc = np.repeat(np.arange(len(self.count)), self.count)
        total, step, end = np.zeros(n, U), U(1), self.first[1:][doc]
        at = np.arange(n)
        for j in range(k):
            step = U((int(step) * int(_STEP) + 1) & (2**64 - 1))
            there = at + j < end
            total += np.where(there, self.hash[np.minimum(at + j, n - 1)] * step, U(0))
        keep = (at + k <= end) | (at == self.first[:-1][doc])
        first = np.concatenate([[0], np.cumsum(np.where(self.count >= k, self.count - k + 1, np.minimum(self.count, 1)))])
        return mix(total[keep], 7), first


def shingle_counts(sh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with how often it has them: text number, shingle, count; in order of text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((sh, doc))
    d, s = doc[order], sh[order]
    new = np.ones(len(s), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(np.append(at, len(s)))
