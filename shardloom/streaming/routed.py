"""Routing a stream of rows to shards, each micro-batch by one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shardloom.operators.strategies import Allocation
from shardloom.sources.tables import TableStore


def routed(stream: DataFrame, key: str, allocation: Allocation) -> DataFrame:
    """The stream with ``_shard``; stateless, so any output mode will do. Random placement is not repeatable."""
    return stream.withColumn("_shard", allocation.column(key))


def write_routed(stream: DataFrame, store: TableStore, table: str, key: str, allocation: Allocation, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to a sharded table; its number is recorded with it, so one that is run again is skipped."""

    def batch(df: DataFrame, n: int) -> None:
        store.append(table, df.withColumn("_shard", allocation.column(key)), label=f"{checkpoint}#{n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
