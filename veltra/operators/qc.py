"""Variant quality control on long genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weights import d


def variant_metrics(variants: DataFrame, genotypes: DataFrame, n_samples: int | Column, absent_is_zero: bool = True) -> DataFrame:
    """variants with call_rate, maf and hwe_chi2 (1 degree of freedom; 0 where it isn't defined).

    absent_is_zero: genotypes that aren't stored are homozygous for the reference, a null dosage is missing. The MAF's
    denominator is all samples, missing ones too.
    """
    n = F.lit(n_samples) if isinstance(n_samples, int) else n_samples
    counts = genotypes.groupBy("variant_id").agg(
        F.count("dosage").alias("seen"),
        F.count(F.lit(1)).alias("stored"),
        F.count_if(F.col("dosage") == 1).alias("het"),
        F.count_if(F.col("dosage") == 2).alias("hom"),
    )
    joined = variants.join(counts, "variant_id", "left").na.fill(0, ["seen", "stored", "het", "hom"])
    called = (F.col("seen") + (n - F.col("stored"))) if absent_is_zero else F.col("seen")
    joined = joined.withColumn("called", called.cast("double"))
    alleles = (F.col("het") + 2 * F.col("hom")).cast("double")
    f = alleles / (2 * n)
    p = F.try_divide(alleles, 2 * F.col("called"))
    e0, e1, e2 = (1 - p) * (1 - p) * F.col("called"), 2 * p * (1 - p) * F.col("called"), p * p * F.col("called")
    ref = F.col("called") - F.col("het") - F.col("hom")
    term = lambda o, e: F.try_divide((o - e) * (o - e), e)
    chi2 = term(ref, e0) + term(F.col("het"), e1) + term(F.col("hom"), e2)
    defined = (F.col("called") >= 2) & (p > 0) & (p < 1)
    return joined.select(
        *variants.columns,
        (F.col("called") / n).alias("call_rate"),
        F.least(f, 1 - f).alias("maf"),
        F.when(defined, F.coalesce(chi2, d(0))).otherwise(d(0)).alias("hwe_chi2"),
    )


#: The chi-square statistic (1 degree of freedom) whose tail is 1e-6.
CHI2_AT_1E6 = 23.928126979050603


def removal_reason(metrics: DataFrame, min_qual: float = 30.0, min_call_rate: float = 0.9, max_chi2: float = CHI2_AT_1E6, max_maf: float = 0.01) -> DataFrame:
    """metrics with reason: the first test that a variant fails, null if it passes; 0 (or 1 for the MAF) turns one off."""
    reason = (
        F.when((F.lit(min_qual) > 0) & (F.col("qual") < min_qual), "low_qual")
        .when((F.lit(min_call_rate) > 0) & (F.col("call_rate") < min_call_rate), "low_call_rate")
        .when((F.lit(max_chi2) > 0) & (F.col("hwe_chi2") > max_chi2), "hwe_fail")
        .when((F.lit(max_maf) < 1) & (F.col("maf") > max_maf), "high_maf")
    )
    return metrics.withColumn("reason", reason)


def filter_variants(metrics_with_reason: DataFrame) -> DataFrame:
    return metrics_with_reason.where("reason is null").drop("reason")


def mask_genotypes(genotypes: DataFrame, min_gq: float | None = None, min_dp: float | None = None) -> DataFrame:
    """Dosages under either threshold become null; a null quality passes. Adds masked."""
    low = F.lit(False)
    for name, least in (("gq", min_gq), ("dp", min_dp)):
        if least is not None:
            low = low | F.coalesce(F.col(name) < least, F.lit(False))
    return genotypes.withColumn("masked", low).withColumn("dosage", F.when(~F.col("masked"), F.col("dosage")))


def annotation_coverage(variants: DataFrame) -> DataFrame:
    """One row: how many variants have gene, consequence and CADD, in percent, and whether the data are usable."""
    share = lambda c: F.try_divide(F.lit(100.0) * F.count_if(c), F.count(F.lit(1)))
    out = variants.agg(
        F.count(F.lit(1)).alias("n_variants"),
        share((F.col("gene") != "") & F.col("gene").isNotNull()).alias("pct_gene"),
        share((F.col("consequence") != "") & F.col("consequence").isNotNull()).alias("pct_consequence"),
        share(F.col("cadd") > 0).alias("pct_cadd"),
    )
    return out.withColumn("usable", F.coalesce(F.col("pct_gene") >= 50, F.lit(False)))


def sample_overlap(data: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """One row: samples in both, in the data alone and in the phenotypes alone."""
    a, b = data.select("sample_id").distinct(), phenotypes.select("sample_id").distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("v")).select(F.lit(name).alias("side"), "v")
    rows = count(a.join(b, "sample_id", "left_semi"), "both").union(count(a.join(b, "sample_id", "left_anti"), "data_only"))
    return rows.union(count(b.join(a, "sample_id", "left_anti"), "phenotypes_only"))
