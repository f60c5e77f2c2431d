"""Read-through cache with expiry, and namespaced secondary lookups, over a key-value store."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from shardloom.sources.kv import KVStore, all_keys


class Cache:
    """Values are JSON with their expiry in band, so any store will do."""

    def __init__(self, kv: KVStore, clock=time.time):
        self.kv, self.clock = kv, clock

    def cached(self, key: str, fetch: Callable[[], Any], ttl: float | None = None) -> Any:
        """The unexpired value, else ``fetch()`` stored; damaged entries are fetched again."""
        if (raw := self.kv.get(key)) is not None:
            try:
                box = json.loads(raw)
                if box.get("e") is None or box["e"] > self.clock() * 1000:
                    return box["v"]
            except (ValueError, KeyError, AttributeError, TypeError):
                pass
            self.kv.delete(key)
        value = fetch()
        self.kv.put(key, json.dumps({"v": value, "e": None if ttl is None else (self.clock() + ttl) * 1000}), ttl)
        return value

    def invalidate(self, prefix: str) -> int:
        keys = all_keys(self.kv, prefix)
        for k in keys:
            self.kv.delete(k)
        return len(keys)


class Lookups:
    """``namespace:key -> value`` beside the mapping."""

    def __init__(self, kv: KVStore):
        self.kv = kv

    def set(self, namespace: str, key: str, value: str) -> None:
        self.kv.put(f"lookup:{namespace}:{key}", value)

    def get(self, namespace: str, key: str) -> str | None:
        return self.kv.get(f"lookup:{namespace}:{key}")

    def delete(self, namespace: str, key: str) -> None:
        self.kv.delete(f"lookup:{namespace}:{key}")
