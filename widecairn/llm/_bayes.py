"""When to give up on a pair whose MinHash values are compared a few at a time."""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np


def posterior_reaches(matches: int, compared: int, threshold: float) -> float:
    """Probability that the similarity is at least ``threshold``, with a uniform prior.

    The posterior is Beta(matches + 1, compared - matches + 1); its upper tail equals the
    probability of at most ``matches`` successes in compared + 1 trials.
    """
    n = compared + 1
    return float(sum(comb(n, i) * threshold**i * (1 - threshold) ** (n - i) for i in range(matches + 1)))


@lru_cache(maxsize=16)
def least_matches(total: int, step: int, threshold: float, tolerance: float) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches with which a pair goes on) after each step."""
    out = []
    for n in range(step, total + 1, step):
        out.append((n, next((m for m in range(n + 1) if posterior_reaches(m, n, threshold) >= tolerance), n + 1)))
    return tuple(out)


def prune(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i of a, j of b) that survive all steps."""
    matches, before = np.zeros(len(i), dtype=np.int32), 0
    for n, least in least_matches(a.shape[1], step, threshold, tolerance):
        if not len(i):
            break
        matches += (a[i, before:n] == b[j, before:n]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        i, j, matches, before = i[keep], j[keep], matches[keep], n
    return i, j
