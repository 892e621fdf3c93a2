"""Session helpers shared by every module: session builder, tables, shared folder, checked broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veltra")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def session(master: str | None = None) -> SparkSession:
    """The session that is active, or one on the given master, or on the one that the environment sets (as spark-submit
    does); a local one only where none is set."""
    from pyspark import SparkConf

    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    if master is None and SparkConf().get("spark.master") is None:
        return local_session()
    builder = SparkSession.builder.appName("veltra")
    return (builder.master(master) if master else builder).getOrCreate()


def numbered(df: DataFrame, *by: str, name: str = "i") -> DataFrame:
    """df with the number of each row, from 0, in the order of by: ranges are sorted apart, and what lies before a range
    is added, so that no task sees all rows. by must tell rows apart, or equal ones are numbered in any order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    placed = cut(ranges.withColumn("__at", F.monotonically_increasing_id()))  # the range in the upper bits
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")  # a row a range
    sizes = F.broadcast(sizes.select("__part", before.alias("__before")))
    return placed.withColumn("__part", part).join(sizes, "__part").withColumn(name, F.col("__before") + place).drop("__part", "__at", "__before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veltra-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: an eager, reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Summary rows (one a pathway, gene or batch) to be joined back: computed once, and broadcast only after a check of
    their number."""
    return broadcast_if_small(cut(df), max_rows)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint, only if the (already materialised) side has at most max_rows rows; else a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
