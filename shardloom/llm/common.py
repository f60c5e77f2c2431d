"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; only Spark's readers touch the path."""
    name_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster without that path, pass the package with ``--py-files``.
    """
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), home])


def ready_checkpoints(spark: SparkSession) -> None:
    """Make sure ``DataFrame.checkpoint`` has a folder.

    ``spark.checkpoint.dir`` wins. Where it is unset, a cluster gets a folder
    in its (shared) warehouse and a local session a temporary folder.
    """
    name_package(spark)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif (sc.master or "").startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shardloom-ckpt-"))
    else:
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder (replayable, not local)."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as Parquet in the shared checkpoint folder, and what deletes it there.

    For large steps: compressed, of known size to Catalyst, and, unlike a
    checkpoint, without a reference to the shuffles it was made by. Delete it once
    nothing lazy reads it any more.
    """
    spark = df.sparkSession
    ready_checkpoints(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)

    def forget() -> None:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)

    return spark.read.schema(df.schema).parquet(path), forget


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner take shuffle files and checkpoints that nothing refers to any more.

    It learns of them by the driver's garbage collection, which else may come long
    after the next large step has filled the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return this process's freed memory, Arrow's and C's, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for ``mapInArrow``, over ``rows`` rows at a time, after which the worker gives back what it has freed.

    Workers live on after a task and serve later steps; what one step's batches took, and the
    last batch that was handed on, would else stand beside the memory of those.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        give_back()

    return out


def crc_mod(col: Column | str, n: int) -> Column:
    """crc32 of the value's decimal text, modulo ``n``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
