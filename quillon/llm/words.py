"""Hashes of all words of a batch of texts, in numpy.

Words are runs of bytes that a rule takes for theirs (not ASCII white space, or letters and digits),
A-Z lowered. A word's hash is a polynomial in its
bytes modulo 2^64, mixed: prefix sums over the whole batch give every word's value in a few array
operations, without a Python object a word. Equal words have equal hashes; different ones differ but
for a chance of some 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes hashed together: the arrays of one step take some 40 times as much.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes between words: ASCII white space; or all ASCII but letters and digits.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Lowered byte plus 1, so that no byte counts 0.
_VALUE = np.array([(b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)


def _hash(data: np.ndarray, starts: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in data, where they begin and end; no word goes on over a start."""
    space = between[data]
    word = ~space
    first, last = word.copy(), word.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    first[starts] = word[starts]
    ends = starts[starts > 0] - 1
    last[ends] = word[ends]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _tables() if len(data) <= CHUNK else (_powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), a, b


def _cuts(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of at most CHUNK bytes that end where a text or a word does; a longer word stays whole."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(end, at + CHUNK)
        if to < end:
            whole = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if whole > at:
                to = whole
            else:  # a text longer than a piece: back to its last white space, or on to its next
                stop = int(offsets[np.searchsorted(offsets, at, "right")])
                gaps = np.flatnonzero(between[data[at:to]])
                later = np.flatnonzero(between[data[to:stop]]) if not len(gaps) else gaps
                to = at + int(gaps[-1]) + 1 if len(gaps) else to + int(later[0]) + 1 if len(later) else stop
        yield at, to
        at = to


class Words:
    """All words of a batch: hash, begin and end (bytes of data), and the first word of each text (at, with the end)."""

    def __init__(self, texts: pa.Array, between: np.ndarray = WHITE):
        col = texts.cast(pa.binary()).fill_null(b"")
        n = len(col)
        raw, body = col.buffers()[1:] if n else (None, None)
        self.offsets = np.frombuffer(raw, np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        parts = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for a, b in _cuts(self.data, self.offsets, between):
            inside = self.offsets[(self.offsets >= a) & (self.offsets < b)] - a
            h, begin, end = _hash(self.data[a:b], np.unique(inside), between)
            for part, x in zip(parts, (h, begin + a, end + a)):
                part.append(x)
        self.hash, self.begin, self.end = map(np.concatenate, parts)
        self.at = np.searchsorted(self.begin, self.offsets)

    def word(self, i: int) -> bytes:
        """The i-th word, lowered."""
        return self.data[self.begin[i] : self.end[i]].tobytes().lower()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each text's begin (with the end). Null is empty."""
    w = Words(texts)
    return w.hash, w.at
