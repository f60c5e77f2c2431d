"""Hashed character n-grams of whole texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_STEP = np.uint32(0x9E3779B1)  # odd multiplier, 2^32 / golden ratio
#: Characters that are hashed at once, to bound memory on very long texts.
BLOCK = 1 << 20


def hashed(text: str, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Arrays of hashes below ``2**bits``, all n-grams of ``text`` of each size.

    Blocks overlap by the longest size less one, so no n-gram is lost or
    repeated. Texts shorter than a size have none of that size.
    """
    top = max(sizes)
    shift = np.uint32(32 - bits)
    for at in range(0, len(text), BLOCK):
        c = np.frombuffer(text[at : at + BLOCK + top - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        h = c.copy()
        for n in range(1, top + 1):
            if n > len(c):
                break
            if n > 1:
                h = h[: len(c) - n + 1] * _STEP + c[n - 1 :]
            if n in sizes:
                g = h[:BLOCK] + np.uint32(n)
                g ^= g >> np.uint32(15)
                yield (g * _STEP) >> shift
