"""Shingles and minhashes of whole texts in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from snapdelta.llm.common import lower_words

_rng = np.random.default_rng(20240229)
WORD_WEIGHTS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over the whole value."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of ``size`` words as sorted 64-bit hashes; a shorter text is one shingle, none if empty."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < size:
        return mix((h * WORD_WEIGHTS[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += h[k : k + n] * WORD_WEIGHTS[k]
    return np.unique(mix(total))


def minhashes(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The least value of every hash function over the shingles, a block of shingles at a time."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[k : k + 4096, None] * factors + terms).min(axis=0), out=least)
    return least
