"""Fan-out over shards: per-shard and global reads of one logical table with ``_shard``."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.errors import EngineError
from shardloom.functions.idents import check_arity
from shardloom.functions.text import natural_order

BATCH = 50


@dataclass
class Outcome:
    shard: str
    success: bool
    rows: list = field(default_factory=list)
    error: str | None = None


@dataclass
class Merged:
    """Rows of all shards that answered; ``success`` only if all did."""

    rows: list
    success: bool
    error: str | None
    outcomes: list[Outcome]


def shard_frame(df: DataFrame, shard: str, shards: list[str] | None = None) -> DataFrame:
    """One shard's rows: a literal partition predicate, so other shards' files are pruned."""
    if shards is not None and shard not in shards:
        raise EngineError(f"Shard {shard} not found", "SHARD_NOT_FOUND")
    return df.where(F.col("_shard") == shard).drop("_shard")


def shard_sql(spark: SparkSession, tables: dict[str, DataFrame], shard: str, sql: str, args: list | None = None) -> DataFrame:
    """Any SQL, joins included, over one shard's rows of the tables; ``?`` are positional."""
    check_arity(sql, args)
    for name, df in tables.items():
        shard_frame(df, shard).createOrReplaceTempView(name)
    return spark.sql(sql, args=list(args or []))


def all_shards_sql(spark: SparkSession, tables: dict[str, DataFrame], shards: list[str], sql: str, args: list | None = None) -> DataFrame:
    """The same SQL on every shard in one plan, with ``_shard``; a LIMIT counts per shard."""
    parts = [shard_sql(spark, tables, s, sql, args).withColumn("_shard", F.lit(s)) for s in shards]
    if not parts:
        raise EngineError("No shards configured", "NO_SHARDS")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def isolated(shards: list[str], run, batch: int = BATCH) -> Merged:
    """``run(shard) -> rows`` for each shard on a small pool; a failure stays that shard's own."""
    size = int(batch) if isinstance(batch, int | float) and math.isfinite(batch) else BATCH

    def one(shard: str) -> Outcome:
        try:
            return Outcome(shard, True, list(run(shard)))
        except Exception as e:  # noqa: BLE001  any failure of a shard is its outcome
            return Outcome(shard, False, [], str(e))

    with ThreadPoolExecutor(max(1, size)) as pool:
        outcomes = list(pool.map(one, shards))
    bad = [o.error for o in outcomes if not o.success]
    return Merged([r for o in outcomes for r in o.rows], not bad, "; ".join(bad) or None, outcomes)


def order(column: str | Column, direction: str = "asc", natural: bool = False) -> list[Column]:
    """Sort columns: nulls last ascending, first descending; ``natural``: strings by natural order."""
    c = F.col(column) if isinstance(column, str) else column
    c = natural_order(c) if natural else c
    return [c.desc_nulls_first() if direction.lower() == "desc" else c.asc_nulls_last()]


def per_shard_top(df: DataFrame, by: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every shard (a LIMIT that each shard applies)."""
    w = Window.partitionBy("_shard").orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def whole(value, default: int | None, least: int = 0) -> int | None:
    """A limit, offset or page as a whole number; what is not finite counts as not given."""
    if value is None or not math.isfinite(value):
        return default
    return max(least, math.floor(value))


def global_rows(df: DataFrame, where: Column | None = None, by: list[Column] = (), offset: float = 0, limit: float | None = None) -> DataFrame:
    """Filter, sort, offset and limit over all shards: a top-k, not a sort of everything."""
    out = df if where is None else df.where(where)
    if by:
        out = out.orderBy(*by)
    if n := whole(offset, 0):
        out = out.offset(n)
    n = whole(limit, None)
    return out if n is None else out.limit(n)


def total(df: DataFrame, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).agg(F.count("*").alias("total"))


def paginate(df: DataFrame, where: Column | None = None, by: list[Column] = (), page: float = 1, limit: float = 20) -> DataFrame:
    """One page with columns total, page, limit and pages beside the rows (1-based; no rows past the end)."""
    limit, page = whole(limit, 20, 1), whole(page, 1, 1)
    rows = global_rows(df, where, by, (page - 1) * limit, limit)
    count = total(df, where)  # one row
    pages = F.ceil(F.col("total") / limit).cast("long")
    return rows.join(F.broadcast(count)).withColumns({"page": F.lit(page), "limit": F.lit(limit), "pages": pages})


def counts(df: DataFrame, shards: list[str]) -> DataFrame:
    """(shard, count) of every shard, empty ones with 0."""
    spark = df.sparkSession
    every = spark.createDataFrame([(s,) for s in shards], "shard string")
    found = df.groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("count"))
    return every.join(found, "shard", "left").select("shard", F.coalesce("count", F.lit(0)).alias("count"))


def lookup(df: DataFrame, mapped: str | None, where: Column, shards: list[str]) -> DataFrame:
    """Rows from the mapped shard; where it has none, from all shards. Never changes a mapping."""
    if mapped in shards:
        own = df.where((F.col("_shard") == mapped) & where)
        if not own.isEmpty():
            return own
    return df.where(where)
