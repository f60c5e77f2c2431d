"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the warehouse; a local session without the first gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if base := sc.getConf().get("spark.checkpoint.dir"):
        return base
    if (sc.master or "").startswith("local["):
        return f"file://{tempfile.mkdtemp(prefix='shardloom-')}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def scratch(spark: SparkSession) -> str:
    """A new folder there."""
    return f"{shared(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def ready_checkpoints(spark: SparkSession) -> None:
    """Make sure that ``checkpoint`` has a folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared(spark))
