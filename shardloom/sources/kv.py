"""Key-value stores: the protocol, an in-memory one with expiry, wrappers and snapshots."""

from __future__ import annotations

import json
import time
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

from shardloom.errors import EngineError


@runtime_checkable
class KVStore(Protocol):
    def get(self, key: str) -> str | None: ...
    def put(self, key: str, value: str, ttl: float | None = None) -> None: ...
    def delete(self, key: str) -> None: ...
    def list(self, prefix: str = "", cursor: str | None = None, limit: int = 1000) -> dict: ...


class MemoryKV:
    """Strings by key with optional expiry (seconds); listing is sorted and paged by cursor."""

    def __init__(self, clock=time.time):
        self._data: dict[str, tuple[str, float | None]] = {}
        self._clock = clock

    def _live(self, key: str) -> bool:
        hit = self._data.get(key)
        if hit and hit[1] is not None and hit[1] <= self._clock():
            del self._data[key]
            return False
        return hit is not None

    def get(self, key: str) -> str | None:
        return self._data[key][0] if self._live(key) else None

    def put(self, key: str, value: str, ttl: float | None = None) -> None:
        self._data[key] = (value, None if ttl is None else self._clock() + ttl)

    def delete(self, key: str) -> None:
        self._data.pop(key, None)

    def keys(self, prefix: str = "") -> list[str]:
        return sorted(k for k in list(self._data) if k.startswith(prefix) and self._live(k))

    def list(self, prefix: str = "", cursor: str | None = None, limit: int = 1000) -> dict:
        rest = [k for k in self.keys(prefix) if cursor is None or k > cursor]
        page = rest[:limit]
        done = len(page) == len(rest)
        return {"keys": page, "complete": done, "cursor": None if done else page[-1]}

    def clear(self) -> None:
        self._data.clear()

    def __len__(self) -> int:
        return len(self.keys())

    def frame(self, spark: SparkSession, prefix: str = "") -> DataFrame:
        """Live entries for analytics."""
        return spark.createDataFrame([(k, *self._data[k]) for k in self.keys(prefix)], "key string, value string, expires_at double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MemoryKV:
        out = cls()
        for r in spark.read.parquet(path).toLocalIterator():
            out._data[r.key] = (r.value, r.expires_at)
        return out


# Names that other clients give to the four operations.
NAMES = {"get": ("get", "getItem", "get_item"), "put": ("put", "set", "setItem", "set_item"), "delete": ("delete", "del", "removeItem", "remove_item", "del_"), "keys": ("keys", "getKeys", "get_keys")}


class ClientKV:
    """Any client that has the operations under one of the known names (Redis-like, storage-like)."""

    def __init__(self, client: Any):
        found = {op: next((getattr(client, n) for n in names if callable(getattr(client, n, None))), None) for op, names in NAMES.items()}
        if missing := [op for op in ("get", "put", "delete") if found[op] is None]:
            raise EngineError(f"client lacks {missing}", "NO_KV")
        self._op, self._client = found, client

    def get(self, key: str) -> str | None:
        v = self._op["get"](key)
        return v.decode() if isinstance(v, bytes) else v

    def put(self, key: str, value: str, ttl: float | None = None) -> None:
        self._op["put"](key, value) if ttl is None else self._op["put"](key, value, ttl)

    def delete(self, key: str) -> None:
        self._op["delete"](key)

    def list(self, prefix: str = "", cursor: str | None = None, limit: int = 1000) -> dict:
        if callable(scan := getattr(self._client, "scan_iter", None)):
            names = scan(match=prefix + "*", count=500)
        else:
            names = self._op["keys"](prefix)
        rest = sorted(k for k in (n.decode() if isinstance(n, bytes) else n for n in names) if k.startswith(prefix) and (cursor is None or k > cursor))
        return {"keys": rest[:limit], "complete": len(rest) <= limit, "cursor": rest[limit - 1] if len(rest) > limit else None}


def get_json(kv: KVStore, key: str) -> Any:
    raw = kv.get(key)
    if raw is None:
        return None
    try:
        return json.loads(raw)
    except ValueError as e:
        raise EngineError(f"value of {key} is no JSON", "KV_JSON_PARSE_FAILED") from e


def is_kv_store(x: Any) -> bool:
    return isinstance(x, KVStore)


def all_keys(kv: KVStore, prefix: str) -> list[str]:
    """Every key, page by page."""
    out, cursor = [], None
    while True:
        page = kv.list(prefix, cursor)
        out += page["keys"]
        if page["complete"]:
            return out
        cursor = page["cursor"]
