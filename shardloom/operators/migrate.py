"""Onboarding of tables that exist already: discover, validate, map, move."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.errors import EngineError
from shardloom.operators.mapping import Mapping
from shardloom.operators.strategies import Allocation, round_robin

# Columns whose values serve as further lookup keys.
ALIASES = ("username", "email", "name")


def discover_keys(table: DataFrame, key: str = "id") -> DataFrame:
    if key not in table.columns:
        raise EngineError(f"No column {key}", "DISCOVERY_FAILED")
    return table.select(F.col(key).cast("string").alias("key"))


def discover_records(table: DataFrame, key: str = "id") -> DataFrame:
    """Keys with whichever alias columns the table has."""
    if key not in table.columns:
        raise EngineError(f"No column {key}", "DISCOVERY_FAILED")
    return table.select(F.col(key).cast("string").alias("key"), *[a for a in ALIASES if a in table.columns and a != key])


@dataclass
class Validation:
    is_valid: bool
    record_count: int
    issues: list[str] = field(default_factory=list)


def validate_frame(table: DataFrame, key: str = "id") -> DataFrame:
    """(records, nulls, repeats) of a key column, in one aggregation by key."""
    by = table.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.when(F.col("k").isNotNull() & (F.col("n") > 1), 1)), F.lit(0)).cast("long").alias("repeats"))


def validate(table: DataFrame | None, key: str = "id") -> Validation:
    """A table can be sharded if it exists, has the key, has rows, and the key is unique and never null."""
    if table is None:
        return Validation(False, 0, ["table does not exist"])
    if key not in table.columns:
        return Validation(False, 0, [f"no primary key column {key}"])
    r = validate_frame(table, key).head()
    issues = [s for bad, s in ((not r.records, "table is empty"), (r.nulls, "null keys"), (r.repeats, "repeated keys")) if bad]
    return Validation(not issues, r.records, issues)


def mappings_for(keys: DataFrame, allocation: Allocation) -> DataFrame:
    """(key, shard) of keys by the allocation; round-robin deals them by their order."""
    if allocation.resolve("write") == "round-robin":
        return round_robin(keys, allocation.shards, "key").select("key", F.col("_shard").alias("shard"))
    return keys.select("key", allocation.column("key").alias("shard"))


@dataclass
class Integration:
    success: bool
    tables: list[str]
    records: int
    issues: list[str]
    mapping: Mapping


def integrate(tables: dict[str, DataFrame], shard: str, mapping: Mapping, key: str = "id", alias_keys: bool = False, dry_run: bool = False) -> Integration:
    """Map every key of every valid table to the shard that holds it already."""
    done, records, issues = [], 0, []
    for name, df in tables.items():
        v = validate(df, key)
        if not v.is_valid:
            issues += [f"{name}: {i}" for i in v.issues]
            continue
        done.append(name)
        records += v.record_count
        if not dry_run:
            aliases = [a for a in ALIASES if alias_keys and a in df.columns and a != key]
            new = Mapping.build(df.withColumn("_shard", F.lit(shard)), key, aliases=aliases, hashed=mapping.hashed)
            fresh = new.keys.dropDuplicates(["key_id"]).join(mapping.keys.select("key_id"), "key_id", "left_anti")
            mapping = Mapping(mapping.keys.unionByName(fresh), mapping.hashed)
    return Integration(not issues or bool(done), done, records, issues, mapping)


def migration_needed(table: DataFrame, mapping: Mapping, key: str = "id") -> bool:
    """Whether any key has no mapping (exactly, not by a sample)."""
    return not mapping.unmapped(table, key).isEmpty()


def auto_migrate(table: DataFrame, mapping: Mapping, shard: str, key: str = "id") -> Mapping:
    """Map all unmapped keys of a shard's table to that shard."""
    pairs = mapping.unmapped(table, key).select(F.col(key).cast("string").alias("key"), F.lit(shard).alias("shard"))
    return mapping.set_batch(pairs)
