"""Gene burdens over an unbounded source of carried variants: a running sum for each sample and gene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.burden import gene_burden


def streaming_burden(variants: DataFrame, genotypes: DataFrame) -> DataFrame:
    """genotypes is a stream, variants a table: a stream-static join and a sum, whose state is a row for each sample and
    gene. To be written in update or complete mode."""
    return gene_burden(variants, genotypes)


def run_once(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Take in all that is there and stop; returns the latest row of each key.

    Each batch writes the rows it changed to a folder of its own, so that a batch that runs twice overwrites itself.
    State and results are on the executors and in the shared folder; nothing comes to the driver.
    """
    spark, out = stream.sparkSession, f"{folder}/out"
    values = [c for c in stream.columns if c not in keys]

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if not query.recentProgress and query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    written = spark.read.schema(stream.schema.add("batch", "integer")).parquet(out)
    return written.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])  # one row of a key in a batch
