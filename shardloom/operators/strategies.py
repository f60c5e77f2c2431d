"""Allocation of keys to shards, as column expressions over whole tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.errors import EngineError
from shardloom.functions.hashing import shard_number
from shardloom.functions.regions import distance

#: Weight of a shard's priority against degrees, and how near to the best score a tie is.
PRIORITY = 0.1
TIE = 0.01
STRATEGIES = ("hash", "location", "random", "round-robin")


@dataclass(frozen=True)
class Location:
    region: str = "wnam"
    priority: float = 1


@dataclass(frozen=True)
class Allocation:
    """Ordered shards and how new keys are dealt to them. ``strategy``: a name, or {"read": ..., "write": ...}."""

    shards: list[str]
    strategy: str | dict[str, str] = "hash"
    target_region: str | None = None
    locations: dict[str, Location] = field(default_factory=dict)
    seed: int = 42

    def resolve(self, operation: str = "write") -> str:
        s = self.strategy
        if isinstance(s, dict):
            s = s.get(operation) or s.get("write") or s.get("read") or "hash"
        if s not in STRATEGIES:
            raise EngineError(f"Unknown strategy {s!r}", "UNKNOWN_STRATEGY")
        return s

    def nearest(self) -> list[str]:
        """Shards that tie for the best score from the target region; all shards where none has a location."""
        placed = [s for s in self.shards if s in self.locations]
        if not placed or not self.target_region:
            return self.shards
        score = {s: distance(self.target_region, self.locations[s].region) - (self.locations[s].priority or 1) * PRIORITY for s in placed}
        best = min(score.values())
        return [s for s in sorted(placed, key=lambda s: score[s]) if score[s] - best < TIE]

    def column(self, key: Column | str, operation: str = "write") -> Column:
        """Shard of each row's key. ``random`` must be materialised before it is used twice;
        ``round-robin`` without an order of rows falls back to hash (see :func:`round_robin`)."""
        if not self.shards:
            raise EngineError("No shards configured", "NO_SHARDS")
        how = self.resolve(operation)
        pool = self.nearest() if how == "location" else self.shards
        names = F.array(*[F.lit(s) for s in pool])
        if how == "random":
            return F.get(names, F.floor(F.rand(self.seed) * len(pool)).cast("int"))
        return F.get(names, shard_number(key, len(pool)))


def round_robin(rows: DataFrame, shards: list[str], order: str, start: int = 0) -> DataFrame:
    """``rows`` with ``_shard`` dealt in turn by the order of a unique column.

    Ranks come from range partitions: a count of each, summed on the driver's
    side of the plan, plus a row number within, so no task sees all rows.
    """
    ranked = rank(rows, order)
    names = F.array(*[F.lit(s) for s in shards])
    return ranked.withColumn("_shard", F.get(names, F.pmod(F.col("_rank") + F.lit(start), F.lit(len(shards))).cast("int"))).drop("_rank")


#: Buckets that rows are ranked in at most; each is sorted by one task.
BUCKETS = 1024


def _measure(rows: DataFrame, column: str) -> Column:
    """A double that never falls as the column rises: a number itself, else six bytes of
    its text after the prefix that the least and the greatest value share."""
    kind = rows.schema[column].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.col(column).cast("double")
    if kind in ("timestamp", "date"):
        return F.col(column).cast("timestamp").cast("double")
    raw = F.col(column).cast("string").cast("binary")
    lo, hi = (bytes(v or b"") for v in rows.select(raw.alias("b")).agg(F.min("b"), F.max("b")).head())
    same = next((i for i, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))  # noqa: B905
    return F.conv(F.rpad(F.hex(F.substring(raw, same + 1, 6)), 12, "0"), 16, 10).cast("double")


def _bucket(measure: Column, cuts: list[float], first: int = 0) -> Column:
    """How many cuts lie below, by halving."""
    if not cuts:
        return F.lit(first)
    k = len(cuts) // 2
    return F.when(measure > F.lit(cuts[k]), _bucket(measure, cuts[k + 1 :], first + k + 1)).otherwise(_bucket(measure, cuts[:k], first))


def rank(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``_rank``: dense positions from 0 by a unique column, nulls first.

    Rows are bucketed by quantiles of the column, numbered within their bucket,
    and lifted by the size of earlier buckets (a table of at most BUCKETS rows),
    so no task sorts all rows.
    """
    n = min(BUCKETS, max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    measure = _measure(rows, order)
    cuts = sorted(set(rows.select(measure.alias("m")).approxQuantile("m", [i / n for i in range(1, n)], 0.5 / n))) if n > 1 else []
    rows = rows.withColumn("_bucket", _bucket(measure, cuts))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    lifts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lift"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(order).asc_nulls_first())) - 1
    # the lifts are one row a bucket, BUCKETS at most
    return rows.withColumn("_own", own).join(F.broadcast(lifts), "_bucket").withColumn("_rank", F.col("_own") + F.col("_lift")).drop("_own", "_lift", "_bucket")


def size_filter(shards: list[str], sizes: dict[str, float | None], limit: float | None) -> list[str]:
    """Shards below ``limit``; unknown sizes are left out; none left (or no limit): all."""
    if not limit or limit <= 0 or limit == float("inf"):
        return shards
    return [s for s in shards if sizes.get(s) is not None and sizes[s] < limit] or shards
