"""Where shards come from: frames, paths, catalog tables, JDBC databases, and discovery by name."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from shardloom.errors import EngineError

# Prefixes of names that stand for shards, and names that never do.
PREFIXES = ("DB_", "DB-", "db-")
RESERVED = ("KV", "CACHE", "EMAIL", "ShardCoordinator", "HYPERDRIVE", "ASSETS", "DB")
DRIVERS = {"postgres": ("postgresql", "org.postgresql.Driver"), "mysql": ("mysql", "com.mysql.cj.jdbc.Driver"), "mariadb": ("mariadb", "org.mariadb.jdbc.Driver"), "sqlite": ("sqlite", "org.sqlite.JDBC")}


def jdbc_options(kind: str, host: str, database: str, port: int | None = None, **more: str) -> dict[str, str]:
    """Options of a JDBC source or sink; the driver's jar must be on Spark's class path."""
    if kind not in DRIVERS:
        raise EngineError(f"Unknown database {kind}", "INVALID_QUERY_INPUT")
    scheme, driver = DRIVERS[kind]
    url = f"jdbc:sqlite:{database}" if kind == "sqlite" else f"jdbc:{scheme}://{host}{f':{port}' if port else ''}/{database}"
    return {"url": url, "driver": driver, **more}


def read_jdbc(spark: SparkSession, options: dict[str, str], table: str | None = None, query: str | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table or query; ``split`` (column, lower, upper, parts) reads a table in parallel ranges."""
    reader = spark.read.format("jdbc").options(**options)
    if split and table:
        column, lo, hi, n = split
        reader = reader.options(partitionColumn=column, lowerBound=str(lo), upperBound=str(hi), numPartitions=str(n))
    return (reader.option("dbtable", table) if table else reader.option("query", query)).load()


def write_jdbc(df: DataFrame, options: dict[str, str], table: str, mode: str = "append") -> None:
    df.write.format("jdbc").options(**options).option("dbtable", table).mode(mode).save()


def as_shard(spark: SparkSession, source: Any) -> DataFrame | None:
    """A frame from a frame, a path, a catalog table's name or JDBC options; None where it is none of these."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, dict) and "url" in source:
        return read_jdbc(spark, {k: v for k, v in source.items() if k not in ("table", "query")}, source.get("table"), source.get("query"))
    if isinstance(source, str):
        if "/" in source:
            kind = source.rsplit(".", 1)[-1] if source.rsplit(".", 1)[-1] in ("csv", "json", "orc") else "parquet"
            return spark.read.format(kind).load(source)
        return spark.table(source) if spark.catalog.tableExists(source) else None
    return None


def shard_name(binding: str) -> str:
    return binding.lower().replace("_", "-")


def discover(spark: SparkSession, env: dict[str, Any], prefixes: tuple[str, ...] = PREFIXES, reserved: tuple[str, ...] = RESERVED, primary: str = "DB", primary_name: str = "db-primary") -> dict[str, DataFrame]:
    """Shards by the names of what ``env`` binds, the primary first."""
    out = {}
    if env.get(primary) is not None and (df := as_shard(spark, env[primary])) is not None:
        out[primary_name] = df
    for name, source in env.items():
        if name not in reserved and name.startswith(prefixes) and source is not None and (df := as_shard(spark, source)) is not None:
            out[shard_name(name)] = df
    if not out:
        raise EngineError("No shards found", "NO_SHARDS")
    return out


def unite(shards: dict[str, DataFrame]) -> DataFrame:
    """One logical table of separate shards, with ``_shard``; columns are matched by name."""
    from pyspark.sql import functions as F

    frames = [df.withColumn("_shard", F.lit(s)) for s, df in shards.items()]
    if not frames:
        raise EngineError("No shards configured", "NO_SHARDS")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
