"""The binary Golay code of length 23, dimension 12 and distance 7, and fuzzy keys made from it.

Every 23-bit word lies within 3 bits of exactly one codeword. A word's *near keys* are all codewords
within 4 bits: one if its nearest codeword is at most 2 away, six if it is 3 away. If two words differ in
at most one bit, the nearest codeword of either is among the near keys of the other. If they differ in at most two,
they share a near key: the errors towards the six near keys of a word divide its bits among them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, DIMENSION = 23, 12
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for shift in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - (LENGTH - DIMENSION))
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; by syndrome the nearest error and the five errors of weight 4 (-1 if none)."""
    unit = np.array([_remainder(1 << i) for i in range(LENGTH)])
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[np.arange(1 << 12) >> i & 1 == 1] ^= unit[i]
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= unit[12 + i]
    nearest, four = np.zeros(1 << 11, np.int64), np.full((1 << 11, 5), -1, np.int64)
    filled = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3, 4):
        for bits in combinations(range(LENGTH), weight):
            error, syndrome = sum(1 << b for b in bits), int(np.bitwise_xor.reduce(unit[list(bits)]))
            if weight < 4:
                nearest[syndrome] = error
            else:
                four[syndrome, filled[syndrome]] = error
                filled[syndrome] += 1
    return low, high, nearest, four


_LOW, _HIGH, NEAREST, FOUR = _tables()


def syndrome(words: np.ndarray) -> np.ndarray:
    return _LOW[words & 0xFFF] ^ _HIGH[words >> 12]


def nearest_key(words: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the nearest codeword."""
    return (words ^ NEAREST[syndrome(words)]) >> (LENGTH - DIMENSION)


def near_keys(words: np.ndarray) -> np.ndarray:
    """Indexes of the codewords within 4 bits, six a word; -1 where there is none."""
    s = syndrome(words)
    errors = np.concatenate((NEAREST[s][:, None], FOUR[s]), axis=1)
    keys = (words[:, None] ^ errors) >> (LENGTH - DIMENSION)
    return np.where(errors < 0, -1, keys)
