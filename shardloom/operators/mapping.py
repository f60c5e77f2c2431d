"""Key-to-shard mapping with several lookup keys per record, as DataFrames.

``keys`` has one row per lookup key: key_id, shard, group_id, original_key,
created_at, updated_at (epoch ms). A record's keys share its group_id, the id
of its primary key.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shardloom.errors import EngineError
from shardloom.functions.hashing import key_id, key_id_of
from shardloom.operators.strategies import Allocation
from shardloom.sources.folders import ready_checkpoints

_ROW = Row("key_id", "shard", "group_id", "original_key", "created_at", "updated_at")
SCHEMA = "key_id string, shard string, group_id string, original_key string, created_at long, updated_at long"


#: Changed keys that are held on the driver before they join the frame.
PENDING = 1000


class Mapping:
    """Every change returns a new mapping.

    Single changes are kept on the driver, over a frame (``base``); after
    ``PENDING`` keys :meth:`materialise` writes both to the checkpoint folder, so
    plans stay short and most keyed reads need no job. Bulk changes are joins.
    """

    def __init__(self, keys: DataFrame | None, hashed: bool = True, spark: SparkSession | None = None, pending: dict[str, tuple | None] | None = None):
        self.base, self.hashed, self.pending = keys, hashed, pending or {}
        self.spark = spark or keys.sparkSession

    @classmethod
    def empty(cls, spark: SparkSession, hashed: bool = True) -> Mapping:
        return cls(None, hashed, spark)

    @property
    def keys(self) -> DataFrame:
        """All rows as one frame."""
        if self.base is not None and not self.pending:
            return self.base
        fresh = self.spark.createDataFrame([r for r in self.pending.values() if r], SCHEMA)
        return fresh if self.base is None else self.base.where(~F.col("key_id").isin(list(self.pending))).unionByName(fresh)

    def materialise(self) -> Mapping:
        """The same mapping as one stored frame, sorted by key so that a key's file range is found by its statistics."""
        ready_checkpoints(self.spark)
        return Mapping(self.keys.sort("key_id").checkpoint(), self.hashed)

    def _with(self, rows: dict[str, tuple | None]) -> Mapping:
        out = Mapping(self.base, self.hashed, self.spark, self.pending | rows)
        return out.materialise() if len(out.pending) > PENDING else out

    @classmethod
    def build(cls, rows: DataFrame, key: str, shard: str = "_shard", aliases: list[str] = (), hashed: bool = True) -> Mapping:
        """Bulk mapping of a placed table; each alias column adds a key ``column:value`` where not null."""
        now = int(time.time() * 1000)
        primary = F.col(key).cast("string")
        names = F.array(primary, *[F.concat(F.lit(f"{a}:"), F.col(a).cast("string")) for a in aliases])
        out = rows.select(F.col(shard).alias("shard"), key_id(primary, hashed).alias("group_id"), F.explode(F.filter(names, lambda x: x.isNotNull())).alias("original_key"))
        out = out.select(key_id("original_key", hashed).alias("key_id"), "shard", "group_id", F.when(F.lit(not hashed), F.col("original_key")).alias("original_key"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
        return cls(out, hashed)

    def _row(self, key: str) -> Row | None:
        k = key_id_of(key, self.hashed)
        if k in self.pending or self.base is None:
            r = self.pending.get(k)
            return r and _ROW(*r)
        return self.base.where(F.col("key_id") == k).head()

    def get(self, key: str) -> str | None:
        row = self._row(key)
        return row.shard if row else None

    def require(self, key: str) -> Row:
        row = self._row(key)
        if row is None:
            raise EngineError(f"No mapping for key {key}", "MAPPING_NOT_FOUND")
        return row

    def _group(self, group: str) -> list[Row]:
        """All rows of a record."""
        out = [_ROW(*r) for r in self.pending.values() if r and r[2] == group]
        if self.base is not None:
            out += [r for r in self.base.where(F.col("group_id") == group).collect() if r.key_id not in self.pending]
        return out

    def _new(self, keys: list[str], shard: str, group: str) -> dict[str, tuple]:
        now = int(time.time() * 1000)
        return {(i := key_id_of(k, self.hashed)): (i, shard, group, None if self.hashed else k, now, now) for k in dict.fromkeys(keys)}

    def set(self, key: str, shard: str, more: list[str] = ()) -> Mapping:
        """Map a primary key and its further lookup keys; existing rows of these keys are replaced."""
        return self._with(self._new([key, *more], shard, key_id_of(key, self.hashed)))

    def set_batch(self, pairs: DataFrame) -> Mapping:
        """Upsert (key, shard) pairs in bulk; of repeated keys the largest shard name counts."""
        now = F.lit(int(time.time() * 1000))
        new = pairs.groupBy(key_id(F.col("key").cast("string"), self.hashed).alias("key_id"), F.col("key").cast("string").alias("k")).agg(F.max("shard").alias("shard"))
        new = new.select("key_id", "shard", F.col("key_id").alias("group_id"), F.when(F.lit(not self.hashed), F.col("k")).alias("original_key"), now.alias("created_at"), now.alias("updated_at"))
        return Mapping(self.keys.join(new.select("key_id"), "key_id", "left_anti").unionByName(new), self.hashed)

    def update(self, key: str, shard: str) -> Mapping:
        """Move a record: any of its keys moves the whole group."""
        now = int(time.time() * 1000)
        return self._with({r.key_id: (r.key_id, shard, r.group_id, r.original_key, r.created_at, now) for r in self._group(self.require(key).group_id)})

    def delete(self, key: str) -> Mapping:
        """Forget a record by any of its keys; an unknown key changes nothing."""
        row = self._row(key)
        return self if row is None else self._with({r.key_id: None for r in self._group(row.group_id)})

    def add_lookup_keys(self, key: str, more: list[str]) -> Mapping:
        row = self.require(key)
        return self._with(self._new(more, row.shard, row.group_id))

    def lookup_keys(self, key: str) -> DataFrame:
        """All keys of the record (their ids where keys are hashed)."""
        group = self.require(key).group_id
        return self.keys.where(F.col("group_id") == group).select(F.coalesce("original_key", "key_id").alias("key"))

    def keys_for_shard(self, shard: str) -> DataFrame:
        return self.keys.where(F.col("shard") == shard).select(F.coalesce("original_key", "key_id").alias("key")).distinct()

    def counts(self, distinct: bool = False) -> DataFrame:
        """(shard, count): lookup keys per shard. By default a record with several keys counts
        each key and again each member of its group, as stored twice; ``distinct`` counts keys once."""
        size = F.count("*")
        if distinct:
            return self.keys.groupBy("shard").agg(size.alias("count"))
        groups = self.keys.groupBy("shard", "group_id").agg(size.alias("n"))
        return groups.groupBy("shard").agg(F.sum(F.col("n") + F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("count"))

    def route(self, rows: DataFrame, key: str, allocation: Allocation, operation: str = "write") -> DataFrame:
        """``rows`` with ``_shard``: the mapped shard of their key, else a newly allocated one (``_new``)."""
        found = self.keys.select("key_id", F.col("shard").alias("_mapped"))
        out = rows.withColumn("key_id", key_id(F.col(key).cast("string"), self.hashed)).join(found, "key_id", "left")
        placed = F.coalesce("_mapped", allocation.column(F.col(key).cast("string"), operation))
        return out.withColumns({"_shard": placed, "_new": F.col("_mapped").isNull()}).drop("key_id", "_mapped")

    def unmapped(self, rows: DataFrame, key: str) -> DataFrame:
        ids = rows.withColumn("key_id", key_id(F.col(key).cast("string"), self.hashed))
        return ids.join(self.keys.select("key_id"), "key_id", "left_anti").drop("key_id")
