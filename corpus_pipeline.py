"""A corpus pipeline of five stages, each an operator of veltra.llm over all rows its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

1. language: documents whose language is rejected go (no text, no letter, or a margin under the model's minimum).
2. lines: repeated and nearly repeated lines are taken out; n_chars is counted anew. Documents stay, even if empty.
3. near duplicates: of each group of texts linked by a similarity of 0.8 or more the smallest doc_id stays; five-word
   shingles, compared exactly.
4. benchmark: documents that hold a benchmark item go.
5. packing: the pieces of all remaining documents in sequences of at most 4096 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veltra.llm import decontaminate, langid, line_dedup, near_copies, packing
from veltra.llm.shared import broadcast_if_small, cut, new_dir, remove, table, written
from veltra.llm.tokens import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.learn_outside_fold(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = docs.columns
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an id stay: they cannot be told apart. Texts without words are equal, so one of them stays. Rows
    that share an id are judged each by its own text."""
    found = near_copies.near_copies(docs, shingle=5, similarity=0.8).where("doc_id != component_id")
    leaving = cut(found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).distinct())
    leaving = broadcast_if_small(leaving, 2_000_000)
    same = (F.col("doc_id") == F.col("__id")) & (near_copies.text_key("text") == F.col("__text"))
    return docs.join(leaving, same, "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, keep_words=False)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("packing", pack),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs, before = stage(spark, docs, sf_dir), path
        if i < len(STAGES) - 1:
            path = new_dir(spark, f"pipeline-{name}")
            docs = written(docs, name, path)
            if before:  # what the stage read; what it wrote stands by itself
                remove(spark, before)
    return docs
