"""Lines of files in their order, however the files are split among tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import numbered


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): line is (file, start of the block, place in it), which orders the lines of all files.

    A block is read by one task from its start to its end, so that places grow with it; they aren't numbers of lines, and
    differ from run to run, but their order does not.
    """
    lines = spark.read.text(path)
    return lines.select(
        "value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).alias("line")
    )


def first_line(lines: DataFrame, condition: Column) -> str | None:
    """The first of the lines that fulfil the condition."""
    row = lines.where(condition).agg(F.min_by("value", "line").alias("value")).first()
    return row["value"]


def behind(lines: DataFrame, condition: Column) -> DataFrame:
    """The lines of each file behind its first line that fulfils the condition: a header stands in each file, or in one."""
    heads = lines.where(condition).groupBy(F.col("line.file").alias("__file")).agg(F.min("line").alias("__head"))  # a row a file
    joined = lines.join(F.broadcast(heads), F.col("line.file") == F.col("__file"), "left")
    return joined.where(F.col("__head").isNull() | (F.col("line") > F.col("__head"))).drop("__file", "__head")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): numbers from 0 in each file, by ranges of all lines."""
    lines = ordered_lines(spark, path).withColumn("__file", F.col("line.file"))
    all_ = numbered(lines, "line", name="__i")
    first = all_.groupBy("__file").agg(F.min("__i").alias("__first"))  # a row a file
    return all_.join(F.broadcast(first), "__file").select("value", (F.col("__i") - F.col("__first")).alias("line"))
