"""Word shingle sets, their MinHash signatures, and exact and sequential comparison of them."""

from __future__ import annotations

from math import comb

import numpy as np

from leafclock.llm.common import WordHashes, mix, pair


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words, A-Z lower-cased.

    A shorter text is one run; without words the set is empty. Two different runs have the
    same hash with a chance of 2 ** -64.
    """
    h = hashes.of(text.lower().split())
    if not len(h):
        return h
    width = min(width, len(h))
    s = mix(h[:len(h) - width + 1] ^ np.uint64(width))
    for j in range(1, width):
        s = pair(s, h[j:len(h) - width + 1 + j])
    return np.unique(s)


def set_id(s: np.ndarray) -> int:
    """A 64-bit hash of a whole set, as a signed number."""
    both = mix(s) + mix(mix(s) ^ np.uint64(len(s)))
    return int(mix(np.array([both.sum(dtype=np.uint64) ^ np.uint64(len(s))], np.uint64)).view(np.int64)[0])


class MinHash:
    """``size`` minima over multiplicative permutations of the hashes, 32 bits each."""

    def __init__(self, size: int):
        self.factor = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def of(self, s: np.ndarray, block: int = 4_096) -> bytes:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), block):
            np.minimum(least, (self.factor[:, None] * s[None, i:i + block]).min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32).tobytes()


def tail(matches: int, n: int, threshold: float) -> float:
    """Chance that the similarity is ``threshold`` or more after ``matches`` of ``n`` values agreed.

    The prior is uniform, so the posterior is Beta(matches + 1, n - matches + 1), whose
    upper tail is a sum of binomial terms.
    """
    return sum(comb(n + 1, i) * threshold ** i * (1 - threshold) ** (n + 1 - i) for i in range(matches + 1))


def least_matches(size: int, step: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n compared values a pair with fewer than m matches is dropped.

    It is dropped where its chance of reaching the threshold is below ``miss``.
    """
    return [
        (n, next((m for m in range(n + 1) if tail(m, n, threshold) >= miss), n))
        for n in range(step, size + 1, step)
    ]


def sequential(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, rule: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of row i of ``a`` and row j of ``b`` survive the rule.

    Later batches compare survivors only, and only a batch of values is copied at a time.
    """
    alive = np.arange(len(i))
    seen, matches = 0, np.zeros(len(i), np.int64)
    for n, m in rule:
        matches[alive] += (a[i[alive], seen:n] == b[j[alive], seen:n]).sum(axis=1)
        alive, seen = alive[matches[alive] >= m], n
    keep = np.zeros(len(i), bool)
    keep[alive] = True
    return keep
