"""Variant files (VCF, plain or gzip) as long tables, with a quality report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G
from . import blocks as B


class VcfError(ValueError):
    pass


@dataclass
class VcfTables:
    """samples in file order; sites (one row a line); variants (one a site and alternative allele); genotypes.

    genotypes (variant_id, sample_id, dosage, valid, gq, dp): only carriers and missing calls if sparse.
    """

    samples: list[str]
    sites: DataFrame
    variants: DataFrame
    genotypes: DataFrame


def _lines(spark: SparkSession, path: str, sample_subset: list[str] | None, blocks: bool | None) -> tuple[DataFrame, list[str]]:
    """(value, chrom, pos) of all lines, and the samples whose calls they have."""
    if blocks is None:
        blocks = path.endswith((".gz", ".bgz", ".bgzf")) and B.is_blocks(path)
    if blocks:
        names, lines = B.header_samples(path), B.block_lines(spark, path, sample_subset)
        return lines, [n for n in names if sample_subset is None or n in set(sample_subset)] if names else []
    f = F.split("value", "\t", 3)
    lines = spark.read.text(path).select("value", F.get(f, 0).alias("chrom"), F.get(f, 1).try_cast("long").alias("pos"))
    header = lines.where("startswith(value, '#CHROM')").limit(1).collect()
    return lines, header[0]["value"].split("\t")[9:] if header else []


def read_vcf(
    spark: SparkSession, path: str, sample_subset: list[str] | None = None, missing_as_null: bool = False, sparse: bool = False, region: tuple[str, int, int] | None = None, blocks: bool | None = None
) -> VcfTables:
    """The tables of a file or folder of files with the same header. Text is split by Spark; the header is one line.

    A block-gzip file (told by its suffix and first bytes, or blocks) is read by ranges of blocks, and only the wanted
    samples and the region leave the reader. region: chromosome, first and last position.

    Lines under nine fields are left out of the tables. An allele that is missing or no number makes a call invalid:
    dosage 0, or null with missing_as_null. An INFO list with an element for each allele gives each its own.
    """
    lines, names = _lines(spark, path, sample_subset, blocks)
    if not names and not (sample_subset is not None and blocks):
        raise VcfError("no #CHROM line with a sample")
    if region is not None:
        lines = lines.where((F.col("chrom") == region[0]) & (F.col("pos") >= region[1]) & (F.col("pos") <= region[2]))
    wanted = None if sample_subset is None else set(sample_subset)
    chosen = [(i, n) for i, n in enumerate(names) if wanted is None or n in wanted]
    body = lines.where("trim(value) != '' and not startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    site_key = F.xxhash64("f")
    info = G.info_map(F.col("f")[7])
    sites = body.select(
        site_key.alias("site"), "f", (F.size("f") >= 9).alias("parsed"), F.split(F.get("f", 4), ",").alias("alts")
    )
    good = sites.where("parsed")
    alleles = good.select("site", "f", "alts", F.posexplode("alts").alias("i", "alt"), info.alias("info"))
    allele, n = F.col("i") + 1, F.size("alts")
    vid = F.when(F.col("f")[2].isin(".", ""), F.concat_ws("_", F.col("f")[0], F.col("f")[1], F.col("f")[3], "alt")).otherwise(
        F.when(n > 1, F.concat_ws("_", F.col("f")[2], allele.cast("string"))).otherwise(F.col("f")[2])
    )
    value = lambda k: G.allele_value(F.try_element_at("info", F.lit(k)), allele, n)
    rows = alleles.select(
        "site", "f", vid.alias("variant_id"), allele.alias("allele"), "alt", n.alias("n_alts"),
        value("GENE").alias("g"), value("CONSEQUENCE").alias("c"), value("CADD").alias("s"),
    )
    f = F.col("f")
    variants = rows.select(
        "variant_id", f[0].alias("chrom"), f[1].try_cast("long").alias("pos"), f[2].alias("id"), f[3].alias("ref"), "alt", "allele", "n_alts",
        G.safe_double(f[5]).alias("qual"), f[6].alias("filter"),
        G.clean_annotation(F.col("g")).alias("gene"), G.clean_annotation(F.col("c")).alias("consequence"), G.safe_double(F.col("s")).alias("cadd"),
    )
    # A row for each name of the header: a line, so that the table is as small as one.
    header_names = F.broadcast(spark.createDataFrame(chosen, "at int, sample_id string"))
    fields = F.slice("f", F.lit(10), F.least(F.size("f") - 9, F.lit(len(names))))
    calls = rows.select("variant_id", "allele", F.split(f[8], ":").alias("format"), F.posexplode(fields).alias("at", "gt")).join(header_names, "at")
    part = F.split("gt", ":")
    at = lambda k: F.get(part, F.array_position("format", k).cast("int") - 1).try_cast("double")
    parsed = calls.select("variant_id", "sample_id", G.genotype(F.col("gt"), F.col("allele")).alias("g"), at("GQ").alias("gq"), at("DP").alias("dp"))
    dosage = F.when(F.col("g.valid"), F.col("g.dosage")).otherwise(F.lit(None) if missing_as_null else F.lit(0)).cast("int")
    genotypes = parsed.select("variant_id", "sample_id", dosage.alias("dosage"), F.col("g.valid").alias("valid"), "gq", "dp")
    if sparse:
        genotypes = genotypes.where("dosage > 0 or not valid")
    return VcfTables([n for _, n in chosen], sites.select("site", "parsed", F.size("alts").alias("n_alts")), variants, genotypes)


@dataclass
class DataQuality:
    total_variants: int = 0
    parsed_variants: int = 0
    skipped_variants: int = 0
    multi_allelic_variants: int = 0
    multi_allelic_expanded: int = 0
    variants_with_gene: int = 0
    variants_with_consequence: int = 0
    variants_with_cadd: int = 0
    missing_genotypes: int = 0
    min_gene_coverage: float = 50.0
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    @property
    def is_usable(self) -> bool:
        return not self.errors and self.parsed_variants > 0 and 100 * self.variants_with_gene >= self.min_gene_coverage * self.parsed_variants


def quality_report(tables: VcfTables, min_gene_coverage: float = 50.0, strict: bool = False) -> DataQuality:
    """Counts over the tables, in one pass over each. At least min_gene_coverage percent of the variants must have a gene.
    strict: raises VcfError if the file will not do, or has lines that can't be read."""
    s = tables.sites.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("parsed").alias("parsed"), F.count_if(F.col("parsed") & (F.col("n_alts") > 1)).alias("multi")
    ).first()
    v = tables.variants.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_alts") > 1).alias("expanded"), F.count_if(F.col("gene") != "").alias("gene"),
        F.count_if(F.col("consequence") != "").alias("consequence"), F.count_if(F.col("cadd") > 0).alias("cadd"),
    ).first()
    missing = tables.genotypes.where("not valid").count()
    report = DataQuality(s["total"], v["n"], s["total"] - s["parsed"], s["multi"], v["expanded"], v["gene"], v["consequence"], v["cadd"], missing, min_gene_coverage)
    if report.skipped_variants:
        report.warnings.append(f"{report.skipped_variants} lines have fewer than 9 fields")
    if not report.parsed_variants:
        report.errors.append("no variant could be parsed")
    elif not report.is_usable:
        report.errors.append("fewer than half of the variants have a gene" if min_gene_coverage == 50.0 else f"under {min_gene_coverage} % of the variants have a gene")
    if strict and (report.errors or report.skipped_variants):
        raise VcfError("; ".join([*report.errors, *report.warnings]))
    return report


def validate_vcf(spark: SparkSession, path: str) -> tuple[bool, DataQuality, list[str]]:
    """Before a run: the report, whether the file will do, and what would help."""
    tables = read_vcf(spark, path)
    report = quality_report(tables)
    if len(tables.samples) < 10:
        report.warnings.append(f"only {len(tables.samples)} samples")
    if report.parsed_variants < 100:
        report.warnings.append(f"only {report.parsed_variants} variants")
    n, advice = max(1, report.parsed_variants), []
    for share, least, text in (
        (report.variants_with_gene, 50, "annotate genes (INFO GENE)"),
        (report.variants_with_consequence, 50, "annotate consequences (INFO CONSEQUENCE)"),
        (report.variants_with_cadd, 30, "annotate CADD scores (INFO CADD)"),
    ):
        if 100 * share / n < least:
            advice.append(text)
    return report.is_usable, report, advice


def write_vcf(variants: DataFrame, path: str) -> None:
    """Sites with their annotation as VCF lines (no genotypes), one file for each partition."""
    missing = lambda c: F.when((F.col(c).isNull()) | (F.col(c).cast("string") == ""), ".").otherwise(F.col(c).cast("string"))
    info = F.concat(F.lit("GENE="), missing("gene"), F.lit(";CONSEQUENCE="), missing("consequence"), F.lit(";CADD="), missing("cadd"))
    columns = [missing(c) for c in ("chrom", "pos", "id", "ref", "alt", "qual", "filter")]
    variants.select(F.concat_ws("\t", *columns, info).alias("value")).write.text(path)
