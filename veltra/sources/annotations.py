"""Annotation files: VEP and ANNOVAR tables, and their merge into variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genotype import safe_double
from ..functions.weights import annovar_consequence
from ..operators.crossref import last_per_key, lookup_by_keys
from .lines import behind, first_line, ordered_lines


def _named(spark: SparkSession, path: str, start: str) -> tuple[DataFrame, list[str]]:
    """(line, f) behind the header that starts with start, and the header's names in lower case."""
    lines, is_header = ordered_lines(spark, path), F.startswith("value", F.lit(start))
    header = first_line(lines, is_header)
    if header is None:
        raise ValueError(f"no header line that starts with {start}")
    names = [x.lstrip("#").strip().lower() for x in header.split("\t")]
    body = behind(lines, is_header).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    return body.select("line", F.split("value", "\t").alias("f")), names


def _get(names: list[str], *wanted: str):
    for w in wanted:
        if w in names:
            x = F.get("f", names.index(w))
            return F.when(x.isin("-", "."), F.lit("")).otherwise(F.coalesce(x, F.lit("")))
    return F.lit("")


def read_vep(spark: SparkSession, path: str) -> DataFrame:
    """(key, gene, consequence, cadd): of lines with one variation the highest CADD, of equals the first."""
    rows, names = _named(spark, path, "#Uploaded_variation")
    out = rows.select(
        "line", _get(names, "uploaded_variation").alias("key"), _get(names, "symbol", "gene").alias("gene"),
        F.split(_get(names, "consequence"), ",")[0].alias("consequence"), safe_double(_get(names, "cadd_phred")).alias("cadd"),
    )
    best = out.groupBy("key").agg(F.min(F.struct((-F.col("cadd")).alias("neg"), "line", "gene", "consequence")).alias("b"))
    return best.select("key", F.col("b.gene").alias("gene"), F.col("b.consequence").alias("consequence"), (-F.col("b.neg")).alias("cadd"))


def read_annovar(spark: SparkSession, path: str) -> DataFrame:
    """(key chrom:pos:ref:alt, gene, consequence, cadd): of lines with one key the last."""
    rows, names = _named(spark, path, "Chr")
    function = F.concat_ws(" ", _get(names, "exonicfunc.refgene"), _get(names, "func.refgene"))
    out = rows.select(
        "line", F.concat_ws(":", _get(names, "chr"), _get(names, "start"), _get(names, "ref"), _get(names, "alt")).alias("key"),
        F.split(_get(names, "gene.refgene"), "[,;]")[0].alias("gene"), annovar_consequence(function).alias("consequence"),
        safe_double(_get(names, "cadd_phred", "cadd")).alias("cadd"),
    )
    return last_per_key(out, "key", "line").drop("line")


def annotate(variants: DataFrame, annotations: DataFrame) -> DataFrame:
    """variants with gene, consequence and cadd of the first key that is annotated: id, c:p:r:a, c_p_r_a, c_p_r/a."""
    by = lambda *s: F.concat("chrom", F.lit(s[0]), F.col("pos").cast("string"), F.lit(s[1]), "ref", F.lit(s[2]), "alt")
    known = F.when(~F.col("id").isin(".", ""), F.col("id"))
    plain = variants.drop("gene", "consequence", "cadd")
    return lookup_by_keys(plain, annotations, [known, by(*":::"), by(*"___"), by(*"__/")], ["gene", "consequence", "cadd"])


def annotation_statistics(variants: DataFrame) -> DataFrame:
    """One row: counts of annotated variants, distinct genes and CADD classes under 15, under 25 and from 25."""
    has = F.col("cadd") > 0
    return variants.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gene") != "").alias("with_gene"), F.count_if(F.col("consequence") != "").alias("with_consequence"),
        F.count_if(has).alias("with_cadd"), F.count_distinct(F.when(F.col("gene") != "", F.col("gene"))).alias("n_genes"),
        F.count_if(has & (F.col("cadd") < 15)).alias("cadd_low"), F.count_if((F.col("cadd") >= 15) & (F.col("cadd") < 25)).alias("cadd_mid"),
        F.count_if(F.col("cadd") >= 25).alias("cadd_high"),
    )
