"""Words, their 64-bit hashes and five-word shingles, vectorised with numpy.

A word is a maximal run without white space, lower-cased.  A text of one to four
words has one shingle, of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
#: Distinct words whose hashes a worker keeps; past it the cache starts anew.
CACHE_WORDS = 120_000

_MASK = (1 << 64) - 1
_GOLD = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def array(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(i: int, seed: int = 0) -> np.uint64:
    return np.uint64(int(mix64(np.array([(_GOLD * (i + 1 + seed * 1000)) & _MASK], dtype=np.uint64))[0]) | 1)


_ODD = [_odd(i) for i in range(64)]


def shingle_hashes(hashes: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of each run of k words, in order, with repeats; fewer than k words make one shingle."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        out += mix64(hashes[i : n - k + 1 + i] ^ _ODD[i]) * _ODD[i]
    return mix64(out + np.uint64(k))


def shingle_set(text: str | None, cache: WordHashes, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(cache.array(words_of(text)), k))


class MinHasher:
    """``count`` 32-bit MinHash values by multiply-add on scrambled shingle hashes."""

    def __init__(self, count: int, seed: int = 1):
        self.a = np.array([int(_odd(i, seed)) & 0xFFFFFFFF | 1 for i in range(count)], dtype=np.uint32)
        self.b = np.array([int(_odd(i, seed + 7)) >> 32 for i in range(count)], dtype=np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(out, (x[i : i + 2048, None] * self.a + self.b).min(axis=0), out=out)
        return out

    def segments(self, shingles: np.ndarray, starts: np.ndarray, together: int = 65536) -> np.ndarray:
        """One row of values for each segment [starts[i], starts[i + 1]), none of them empty."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full((len(starts), len(self.a)), 0xFFFFFFFF, dtype=np.uint32)
        for lo in range(0, len(x), together):
            hi = min(lo + together, len(x))
            first, last = np.searchsorted(starts, (lo, hi - 1), side="right") - 1
            at = np.maximum(starts[first : last + 1], lo) - lo
            part = np.minimum.reduceat(x[lo:hi, None] * self.a + self.b, at, axis=0)
            np.minimum(out[first : last + 1], part, out=out[first : last + 1])
        return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of the bands of one or more signatures; the band's number is part of the key."""
    s = np.atleast_2d(signature).astype(np.uint64)
    bands = s.shape[1] // rows
    s = s[:, : bands * rows].reshape(len(s), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLD), s.shape[:2]).copy()
    for i in range(rows):
        out = mix64(out + s[:, :, i] * _ODD[i])
    return out.view(np.int64)
