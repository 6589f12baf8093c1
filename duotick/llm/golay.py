"""The perfect binary Golay code of 23 bits, as a fuzzy hash of short bit strings.

A word of 23 bits lies within 3 bits of exactly one codeword.  A word at distance 3 is also at distance 4 from exactly five
others, because any three positions lie in five codewords of weight 7.  Give a word the index of its codeword and, at
distance 3, those of the five: then any two words that differ in one bit share a key.  (If both have the same codeword they
share it.  If not, the codewords are 7 apart, so each word is at distance 3 from its own and at distance 4 from the other's.)
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011
MOST_KEYS = 6


def _remainder(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


@cache
def leaders() -> np.ndarray:
    """The error pattern of at most 3 bits for each of the 2,048 remainders."""
    patterns = np.array([0, *(sum(1 << b for b in c) for k in (1, 2, 3) for c in combinations(range(23), k))])
    out = np.zeros(2048, dtype=np.int64)
    out[_remainder(patterns)] = patterns
    return out


@cache
def weight_seven() -> np.ndarray:
    words = codewords()
    return words[np.bitwise_count(words) == 7]


@cache
def codewords() -> np.ndarray:
    """Systematic: the upper 12 bits are the index."""
    top = np.arange(4096, dtype=np.int64) << 11
    return top | _remainder(top)


@cache
def keys(bits: int) -> np.ndarray:
    """For every word of ``bits`` bits, padded with zeros to 23: the indices of its codewords, -1 where it has fewer than six."""
    words = np.arange(1 << bits, dtype=np.int64)
    errors = leaders()[_remainder(words)]
    out = np.full((len(words), MOST_KEYS), -1, dtype=np.int16)
    near = words ^ errors
    out[:, 0] = near >> 11
    far = np.flatnonzero(np.bitwise_count(errors) == 3)
    by_pattern: dict[int, np.ndarray] = {}
    heavy = weight_seven()
    for e in np.unique(errors[far]).tolist():
        by_pattern[e] = heavy[(heavy & e) == e]
    others = np.array([by_pattern[e] for e in errors[far].tolist()], dtype=np.int64).reshape(len(far), 5)
    out[far, 1:] = (near[far, None] ^ others) >> 11
    return out
