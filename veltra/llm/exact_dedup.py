"""Exact deduplication by a tree-merge of sorted digest runs. DataFrame functions only.

Every input partition starts as a run of (digest, smallest id, largest id, copies), sorted by digest. Runs are numbered
in base ``radix``. In round i, runs whose numbers differ only in digit i exchange pieces: a piece goes to the run whose
digit i equals that digit of the digest's home, and each run merges what it gets, keeping one verified record a digest.
After all rounds a digest is in its home run alone. Only records of 60-odd bytes move, never texts; a digest with a
third of all rows is one record a run before the first exchange.

A record carries the smallest and largest id as structs, which makes Spark sort each run by its key and merge sorted
runs (SortAggregate) rather than hash them. A record is verified by its length in bytes and a second, unrelated 64-bit
hash: both are part of the merge key, so that texts whose SHA-256 alone agreed would stay apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

KEY = ("digest", "n_bytes", "check")


def digested(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    t = F.coalesce(text, F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(t, 256)).alias("digest"),
        F.octet_length(t).alias("n_bytes"),
        F.xxhash64(t, F.lit(1)).alias("check"),
    )


def tree_merge(records: DataFrame, radix_bits: int = 3, rounds: int | None = None) -> DataFrame:
    """One row for each (digest, n_bytes, check): low and high id, copies."""
    radix = 1 << radix_bits
    if rounds is None:
        partitions = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rounds = max(1, math.ceil(math.log(max(2, partitions), radix)))
    runs = radix**rounds
    home = F.pmod(F.xxhash64("digest"), F.lit(runs))
    level = records.select(
        *KEY,
        F.pmod(F.spark_partition_id().cast("long"), F.lit(runs)).alias("run"),
        F.struct("id").alias("low"),
        F.struct("id").alias("high"),
        F.lit(1).cast("long").alias("copies"),
    )
    for i in range(rounds):
        mask = (radix - 1) << (radix_bits * i)
        to = F.col("run").bitwiseAND(F.lit(runs - 1 - mask)).bitwiseOR(home.bitwiseAND(F.lit(mask)))
        level = (
            level.withColumn("run", to)
            .groupBy("run", *KEY)
            .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("copies").alias("copies"))
        )
    return level.select(*KEY, F.col("low.id").alias("low"), F.col("high.id").alias("high"), "copies")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", text: Column | None = None
) -> DataFrame:
    """A row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    text: what to compare, as an expression over docs; by default the column as it is. keep: "smallest" or "largest" id.
    Null and empty texts are one group. A null id is kept only if its whole group has none. Rows that repeat both id and
    text count separately in group_size and share the verdict. An empty table gives an empty result. Other columns of
    docs are not read, so their names cannot clash.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    rows = digested(docs, id_col, F.col(text_col) if text is None else text)
    # A null sorts first in a struct: only the largest id skips nulls by itself.
    merged = tree_merge(rows) if keep == "largest" else tree_merge_nulls_last(rows)
    winner = F.col("high" if keep == "largest" else "low")
    groups = merged.where(F.col("copies") > 1).select(*KEY, winner.alias("keep_id"), "copies")
    joined = rows.join(groups, list(KEY), "left")
    keep_id = F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        keep_id.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def tree_merge_nulls_last(records: DataFrame) -> DataFrame:
    """tree_merge with nulls last among the smallest ids: merged in the reverse order of ids, and turned back."""
    turned = tree_merge(records.withColumn("id", F.bitwise_not("id")))
    low, high = F.bitwise_not("high").alias("low"), F.bitwise_not("low").alias("high")
    return turned.select(*KEY, low, high, "copies")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {
    "op10_exact_dedup": """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
