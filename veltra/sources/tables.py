"""Phenotypes, expression matrices, principal components, reference tables, results of earlier runs."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genotype import safe_double
from ..operators.crossref import last_per_key
from .lines import behind, first_line, ordered_lines


class TableError(ValueError):
    pass


def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    sep = "\t" if re.search(r"\.(tsv|txt)(\.gz)?$", path) else ","
    return spark.read.options(header=True, sep=sep, **options).csv(path)


def read_phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """The first row of each sample_id; raises TableError without that column or any row."""
    df = _csv(spark, path, inferSchema=True)
    if "sample_id" not in df.columns:
        raise TableError("no sample_id column")
    if not df.limit(1).count():
        raise TableError("no phenotype")
    df = df.withColumn("sample_id", F.col("sample_id").cast("string")).withColumn("__row", -F.monotonically_increasing_id())
    return last_per_key(df, "sample_id", "__row").drop("__row")


#: What a gene symbol looks like.
SYMBOL = r"^[A-Z][A-Z0-9]{1,14}$"


def looks_like_symbols(names: list[str], threshold: float = 0.5) -> bool:
    return bool(names) and sum(bool(re.match(SYMBOL, x)) for x in names) / len(names) >= threshold


def genes_are_rows(first_column: list[str], header: list[str], n_rows: int) -> bool:
    """By the look of up to 100 labels on either side; else if there are more than twice as many rows as columns."""
    rows, columns = looks_like_symbols(first_column[:100]), looks_like_symbols(header[:100])
    if rows != columns:
        return rows
    return n_rows > 2 * len(header)


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, gene, value) of a matrix in either orientation; what is no number counts as 0. A row of the file may
    have any number of cells: a line becomes cells where it is read, and columns never are columns of a table."""
    sep = "\t" if re.search(r"\.(tsv|txt)(\.gz)?$", path) else ","
    lines = ordered_lines(spark, path).where(F.length(F.trim("value")) > 0)
    head = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()
    if head is None:
        raise TableError("no header")
    names = _fields(head["value"], sep)[1:]
    rows = behind(lines, F.col("value") == head["value"]).select("value")
    labels = [r[0] for r in rows.mapInArrow(partial(_first_cells, sep=sep), "label string").limit(100).collect()]
    flip = genes_are_rows([str(x) for x in labels], names, rows.count())
    shared = spark.sparkContext.broadcast(names)  # the names of the other side

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value, pa.string())
        for batch in batches:
            for value in batch.column(0).to_pylist():
                key, *found = _fields(value, sep)
                found = (found + [None] * len(names))[: len(names)]
                for at in range(0, len(found), 10_000):
                    part = pa.array(found[at : at + 10_000], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([key or None] * len(part), pa.string()), names[at : at + 10_000], part], ["key", "name", "text"])

    long = rows.mapInArrow(cells, "key string, name string, text string")
    sample, gene = ("name", "key") if flip else ("key", "name")
    return long.select(F.col(sample).alias("sample_id"), F.col(gene).alias("gene"), safe_double(F.col("text")).alias("value"))


def _fields(line: str, sep: str) -> list[str]:
    """The cells of a line; quotes as Spark's reader takes them."""
    csv.field_size_limit(2**31 - 1)
    return next(csv.reader([line], delimiter=sep, escapechar="\\", doublequote=False), [""])


def _first_cells(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_fields(v, sep)[0] or None for v in batch.column(0).to_pylist()], pa.string())], ["label"])


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, pc, value): all columns but the first are components."""
    wide = _csv(spark, path)
    key, *names = wide.columns
    long = wide.unpivot([key], names, "pc", "text")
    return long.select(F.col(key).cast("string").alias("sample_id"), "pc", safe_double(F.col("text")).alias("value"))


def read_clinvar(spark: SparkSession, path: str) -> DataFrame:
    """(symbol in upper case, gene_id, n_pathogenic, n_likely_pathogenic, n_uncertain, n_benign, n_likely_benign).

    The header is the first line that names Symbol, with or without #. A combined column stands for two separate ones.
    Of lines with one symbol the last counts; lines shorter than the header are left out.
    """
    lines, has_symbol = ordered_lines(spark, path), F.contains("value", F.lit("Symbol"))
    header = first_line(lines, has_symbol)
    if header is None:
        raise TableError("no header with Symbol")
    names = [x.strip().lstrip("#").lower() for x in header.split("\t")]
    f = F.split("value", "\t")
    rows = behind(lines, has_symbol).where((F.size(f) >= len(names)) & (F.trim("value") != "")).select("line", f.alias("f"))

    def number(*wanted: str):
        for w in wanted:
            if w in names:
                return F.coalesce(F.trim(F.col("f")[names.index(w)]).try_cast("long"), F.lit(0).cast("long"))
        return F.lit(0).cast("long")

    out = rows.select(
        "line", F.upper(F.trim(F.col("f")[names.index("symbol")])).alias("symbol"), number("geneid").alias("gene_id"),
        number("number_pathogenic", "alleles_reported_pathogenic_likely_pathogenic").alias("n_pathogenic"),
        number("number_likely_pathogenic").alias("n_likely_pathogenic"), number("number_uncertain_significance", "number_uncertain").alias("n_uncertain"),
        number("number_benign").alias("n_benign"), number("number_likely_benign").alias("n_likely_benign"),
    )
    return last_per_key(out, "symbol", "line").drop("line")


def read_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scores and cluster assignments that a run wrote to its folder."""
    wide = _csv(spark, f"{folder}/pathway_scores.csv", inferSchema=True)
    key, *names = wide.columns
    long = wide.select(F.col(key).cast("string").alias("sample_id"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return long.unpivot(["sample_id"], names, "pathway", "score"), _csv(spark, f"{folder}/subtype_assignments.csv", inferSchema=True)


def write_wide(scores: DataFrame, path: str) -> None:
    """A row for each sample, a column for each pathway."""
    names = sorted(r["pathway"] for r in scores.select("pathway").distinct().collect())  # the header; given, it has no limit
    scores.groupBy("sample_id").pivot("pathway", names).agg(F.first("score")).write.mode("overwrite").option("header", True).csv(path)
