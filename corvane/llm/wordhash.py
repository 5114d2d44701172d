"""Vectorised word and shingle hashes over the bytes of an Arrow batch.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased, as the regular expression
``[^\\x20\\x09-\\x0D]+`` gives over lower-cased text: no byte of a longer UTF-8 sequence is in that range.
Each word hashes to 64 bits by a polynomial in random byte codes, read off prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from corvane.llm.runtime import slices

_rng = np.random.Generator(np.random.PCG64(20240229))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as far as the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK + 1)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_powers = Powers()


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of rows: (first row, end row, word hashes, word lengths, words before each row and after the last)."""
    for i, j in slices(offsets, CHUNK):
        lo, hi = int(offsets[i]), int(offsets[j])
        part, bounds = data[lo:hi], offsets[i : j + 1] - lo
        if hi == lo:
            yield i, j, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(j - i + 1, np.int64)
            continue
        gap = SPACE[part]
        first = ~gap
        first[1:] &= gap[:-1]
        inner = bounds[:-1][bounds[:-1] < bounds[1:]]
        first[inner] = ~gap[inner]
        last = ~gap
        last[:-1] &= gap[1:]
        last[inner[1:] - 1] = ~gap[inner[1:] - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        _powers.reach(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODES[part] * _powers.up[: len(part)], out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * _powers.down[begin])
        yield i, j, hashes, end - begin, np.searchsorted(begin, bounds)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word runs of one text; of the whole text if it has fewer words."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        return mix(np.sum(hashes * _PLACES[:n], keepdims=True) + np.uint64(n))
    total = hashes[: n - width + 1] * _PLACES[0]
    for k in range(1, width):
        total = total + hashes[k : n - width + 1 + k] * _PLACES[k]
    return np.unique(mix(total + np.uint64(width)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for i, j, hashes, _, at in hashed_words(data, offsets):
        for k in range(j - i):
            yield i + k, shingles(hashes[at[k] : at[k + 1]], width)
