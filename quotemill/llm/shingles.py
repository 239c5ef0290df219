"""Hashed word shingles of whole texts, and their weighted similarity."""

from __future__ import annotations

from itertools import repeat
from zlib import crc32

import numpy as np

WORDS_PER_SHINGLE = 5
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function of every element (unsigned, wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_codes(text: str) -> np.ndarray:
    """A 64-bit code of every word, words being lower-case runs between white space."""
    words = [w.encode() for w in text.lower().split()]
    low = np.fromiter(map(crc32, words), np.uint64, len(words))
    high = np.fromiter(map(crc32, words, repeat(0x5BD1E995)), np.uint64, len(words))
    return low | high << np.uint64(32)


def shingles(text: str, size: int = WORDS_PER_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text as sorted codes, and how often each occurs. A shorter text is one shingle; one without words has none."""
    codes = word_codes(text)
    if not len(codes):
        return codes, codes.astype(np.int64)
    n = max(1, len(codes) - size + 1)
    code = np.full(n, len(codes[:size]), np.uint64)
    for k in range(min(size, len(codes))):
        code = mixed(code * _STEP + codes[k : k + n])
    return np.unique(code, return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger counts; 0 if either has none."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    same = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum() + b[1].sum()) - same
    return same / union if same else 0.0
