"""Words and word shingles as 64-bit hashes, computed per Arrow batch."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word, remembered; the memory is emptied when it has a million words."""

    limit = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Return the hashes of the lower-case words of ``text``, in order."""
        if not text:
            return np.empty(0, np.uint64)
        words = WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Return the hash of each run of ``k`` consecutive words, in order of position."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * _MIX[0] + words[j : j + n]
    return mix(h)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Return the Jaccard similarity of two sorted arrays of distinct hashes; 0 if one is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
