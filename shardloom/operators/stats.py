"""Shard statistics: rows, bytes and balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.operators.fanout import counts


def balance(df: DataFrame, shards: list[str]) -> DataFrame:
    """(shard, count, load, ratio): share of all rows in percent, and largest over smallest count (null if 0)."""
    c = counts(df, shards)
    t = c.agg(F.sum("count").alias("t"), F.max("count").alias("hi"), F.min("count").alias("lo"))
    return c.join(F.broadcast(t)).select("shard", "count", F.round(F.try_divide(F.lit(100.0) * F.col("count"), F.col("t")), 4).alias("load"), F.round(F.try_divide(F.col("hi").cast("double"), F.col("lo")), 4).alias("ratio"))


def sizes(df: DataFrame) -> DataFrame:
    """(shard, bytes) of the files behind a table that is read from files."""
    files = df.select("_shard", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).groupBy("_shard", "f").agg(F.max("n").alias("n"))
    return files.groupBy(F.col("_shard").alias("shard")).agg(F.sum("n").alias("bytes"))
