"""New ids: the next one over all shards, and dense ids for many rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.operators.strategies import rank


def max_across(df: DataFrame, column: str = "id") -> DataFrame:
    """Largest number in the column over all shards, at least 0; what is no number is ignored."""
    return df.agg(F.greatest(F.coalesce(F.max(F.col(column).try_cast("bigint")), F.lit(0)), F.lit(0)).alias("max_id"))


def next_id(df: DataFrame, column: str = "id", least: float | None = None) -> int:
    top = max_across(df, column).head().max_id + 1
    return max(top, math.floor(least)) if least is not None and math.isfinite(least) else top


def assign_ids(rows: DataFrame, order: str, base: int, name: str = "id") -> DataFrame:
    """Dense ids from ``base`` on, in the order of a unique column."""
    return rank(rows, order).withColumn(name, F.col("_rank") + F.lit(base)).drop("_rank")
