"""Tables, the shared folder and lineage cuts for the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; one of our own only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veltra-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Compute once into a Parquet table of the shared folder (or at path) and read it back; the planner then knows its size."""
    path = path or new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int, weight: Column | None = None) -> DataFrame:
    """A broadcast hint only if the (already materialised) side has at most max_rows rows, or a weight of that in all for
    rows of any size; beyond it a shuffle join."""
    if weight is not None:
        total = df.agg(F.sum(weight)).first()[0] or 0
        return F.broadcast(df) if total <= max_rows else df
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than the session's default of 10,000, for whole texts: a batch is held some times over
    on its way to a worker and back. A session whose setting is another one keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def giving_back(results: Iterator[T]) -> Iterator[T]:
    """results, and then what the worker process has freed goes back to the system: it lives on between tasks."""
    yield from results
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)
