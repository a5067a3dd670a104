"""Word shingles of whole texts as sets of 64-bit hashes, in numpy over many texts at once.

Edge cases: empty texts and texts of blanks have no words and an empty set; fewer words than a shingle are one shingle of
all; equal shingles count once; very long texts are hashed in blocks of whole words.
"""

from __future__ import annotations

import numpy as np

from .common import UPPER_TO_LOWER, mix, range_hash

WORDS = 5
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[UPPER_TO_LOWER]
BLOCK = 1 << 19


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of texts end to end, and the number of words before each text and in all."""
    real = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins, ends = real.copy(), real.copy()
    begins[1:] &= ~real[:-1] | first[1:-1]
    ends[:-1] &= ~real[1:] | first[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # in blocks of whole words, so that powers and sums stay small for very long texts
        j = max(i + 1, int(np.searchsorted(stop, start[i] + BLOCK, "right")))
        a, b = start[i], stop[j - 1]
        out[i:j] = range_hash(LETTER[data[a:b]], start[i:j] - a, stop[i:j] - a)
        i = j
    return out, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted, end to end, with offsets; fewer words than that are one shingle, none none."""
    word, at = word_hashes(data, offsets)
    many = np.diff(at)
    grams = max(0, len(word) - words + 1)
    shingle = np.zeros(grams, np.uint64)
    for k in range(words):
        shingle = mix(shingle) + word[k : k + grams]
    shingle = mix(shingle)
    sets = []
    for a, n in zip(at[:-1], many, strict=True):
        if n >= words:
            sets.append(np.unique(shingle[a : a + n - words + 1]))
        elif n:
            whole = np.full(1, n, np.uint64)
            for k in range(n):
                whole = mix(whole) + word[a + k]
            sets.append(mix(whole))
        else:
            sets.append(word[:0])
    return np.concatenate([word[:0], *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
