"""Key hashes: the 31-polynomial string hash, shard numbers and SHA-256 ids."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_hash(key: Column | str) -> Column:
    """31-polynomial over UTF-16 units with 32-bit wrap, as a long (so abs of the least value is right)."""
    return F.reflect(F.lit("java.util.Objects"), F.lit("hashCode"), _col(key)).cast("long")


def shard_number(key: Column | str, n: int) -> Column:
    return F.pmod(F.abs(string_hash(key)), F.lit(n)).cast("int")


def key_id(key: Column | str, hashed: bool = True) -> Column:
    """Stored id of a key: SHA-256 hex of its UTF-8, or the key itself."""
    return F.sha2(_col(key).cast("binary"), 256) if hashed else _col(key)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def string_hash_of(key: str) -> int:
    """The same hash of one Python string."""
    h = 0
    raw = key.encode("utf-16-le", "surrogatepass")
    for lo, hi in zip(raw[::2], raw[1::2], strict=True):
        h = (h * 31 + lo + 256 * hi) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def shard_number_of(key: str, n: int) -> int:
    return abs(string_hash_of(key)) % n


def key_id_of(key: str, hashed: bool = True) -> str:
    return hashlib.sha256(key.encode()).hexdigest() if hashed else key
