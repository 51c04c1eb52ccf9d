"""The binary Golay code of length 23, and the keys of fuzzy hashing by it.

The code is perfect: each word of 23 bits lies within three bits of exactly one
codeword. A word's keys are the messages (12 bits) of all codewords within four
bits of it: one key if the nearest codeword is within two bits, else six. Two
words that differ in at most two bits always share a key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH = 23
CHECKS = 11


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each word by the generator polynomial."""
    left = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        left ^= np.where((left >> bit) & 1, GENERATOR << (bit - CHECKS), 0)
    return left


def patterns() -> np.ndarray:
    """For each syndrome, the error patterns of weight four at most, repeated to six."""
    errors = [sum(1 << b for b in bits) for weight in range(5) for bits in combinations(range(LENGTH), weight)]
    out = np.full((1 << CHECKS, 6), -1, dtype=np.int64)
    filled = np.zeros(1 << CHECKS, dtype=np.int64)
    for error, s in zip(errors, syndrome(np.array(errors)), strict=True):
        out[s, filled[s]] = error
        filled[s] += 1
    return np.where(out < 0, out[:, :1], out)


def keys(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Six keys (12 bits, repeats where there are fewer) of each word of 23 bits; table: patterns()."""
    words = words.astype(np.int64)
    return (words[:, None] ^ table[syndrome(words)]) >> CHECKS
