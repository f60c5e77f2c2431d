"""The perfect binary Golay code of length 23: nearest codewords as fuzzy keys.

Every 23-bit word lies within distance 3 of exactly one of 4096 codewords.
A codeword is named by its 12 message bits. All functions work on whole numpy
arrays.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

# Fixed value: generator polynomial x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0xAE3
CHECK_BITS = 11
LENGTH = 23


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of ``message << 11``, and the error pattern of each syndrome."""
    rem = np.arange(1 << 12, dtype=np.int64) << CHECK_BITS
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rem = np.where((rem >> bit) & 1, rem ^ (GENERATOR << (bit - CHECK_BITS)), rem)
    patterns = np.array([sum(1 << i for i in c) for w in range(4) for c in combinations(range(LENGTH), w)], dtype=np.int64)
    errors = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    errors[rem[patterns >> CHECK_BITS] ^ (patterns & ((1 << CHECK_BITS) - 1))] = patterns
    return rem, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Message bits of the codeword within distance 3 of each word."""
    rem, errors = _tables()
    syndrome = rem[words >> CHECK_BITS] ^ (words & ((1 << CHECK_BITS) - 1))
    return (words ^ errors[syndrome]) >> CHECK_BITS


def nearby(words: np.ndarray, bits: range) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of the word and of its one-bit changes within ``bits``.

    Returns (row number, message bits) without repeats in a row. Two words of
    distance 2 or less, all differing bits lying in ``bits``, share a codeword.
    """
    flips = np.array([0, *(1 << b for b in bits)], dtype=np.int64)
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    keep = np.ones(found.shape, dtype=bool)
    keep[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(keep)[0], found[keep]
