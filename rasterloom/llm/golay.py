"""The perfect binary Golay code of length 23, as a fuzzy hash.

Every 23-bit word lies within 3 bits of exactly one of 4096 codewords.  A word's
*home* is the index of that codeword; its *keys* are the indices of all codewords
within 4 bits: the home alone where it is nearer than 3, else the home and five
others.  If two words differ in at most one bit, the home of either is among the
keys of the other, as it is at most 3 + 1 bits away.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, INFO = 23, 12
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the code (fixed value).
GENERATOR = 0b101011100011


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(parity of each 12-bit index, for each syndrome the changes of index to the codewords within 4 bits, -1 where there are fewer)."""
    check = LENGTH - INFO

    def remainder(x: int) -> int:
        for bit in range(LENGTH - 1, check - 1, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - check)
        return x

    parity = np.array([remainder(i << check) for i in range(1 << INFO)], np.int64)
    ones = [1 << b for b in range(LENGTH)]
    syndrome = [int(parity[x >> check]) ^ (x & (1 << check) - 1) for x in ones]
    near = np.full((1 << check, 6), -1, np.int64)
    filled = [0] * (1 << check)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            s = x = 0
            for b in bits:
                s ^= syndrome[b]
                x ^= ones[b]
            near[s, filled[s]] = x >> check
            filled[s] += 1
    return parity, near


def _syndrome(words: np.ndarray) -> np.ndarray:
    parity, _ = tables()
    check = LENGTH - INFO
    return parity[words >> check] ^ (words & (1 << check) - 1)


def home(words: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each word."""
    _, near = tables()
    words = np.asarray(words, np.int64)
    return (words >> LENGTH - INFO) ^ near[_syndrome(words), 0]


def keys(words: np.ndarray) -> np.ndarray:
    """Six columns: the home, then the other codewords within 4 bits or -1."""
    _, near = tables()
    words = np.asarray(words, np.int64)
    change = near[_syndrome(words)]
    return np.where(change < 0, -1, (words >> LENGTH - INFO)[:, None] ^ change)
