"""Analyses made of several operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weights import SCHEMES, scheme_weight
from ..session import cut
from . import burden as B
from . import clustering as CL
from . import crossref as X
from . import inference as I
from . import resample as R
from . import simulate as S
from .agreement import adjusted_rand, normalized_mutual_information


def statistical_rigor(scores: DataFrame, groups: DataFrame, alpha: float = 0.05, n_permutations: int = 1000, n_bootstrap: int = 1000, seed: int = 42) -> DataFrame:
    """pathway, p, q, significant, effect_size, lo, hi: permutation test, false-discovery control, largest d and its interval."""
    scores, groups = cut(scores), cut(groups.select("sample_id", "grp"))
    labelled = scores.join(groups, "sample_id")
    stats = cut(I.group_stats(labelled))
    of = drawn_from = R.matrix(scores, groups)
    # Resamples are drawn from the samples that have scores, each once; where these are all, the matrix is the same.
    if not of.rows.select("i").distinct().count() == groups.where("grp is not null").distinct().count() == of.sizes.sum():
        drawn_from = R.matrix(scores, labelled.select("sample_id", "grp").distinct())
    tests = I.benjamini_hochberg(R.permutation_p_of(I.f_statistics(stats), of, n_permutations, seed).select("pathway", "p"))
    out = tests.join(I.largest_d(stats), "pathway").join(R.bootstrap_ci_of(drawn_from, n_bootstrap, seed=seed), "pathway")
    return out.select("pathway", "p", "q", (F.col("q") < alpha).alias("significant"), "effect_size", "lo", "hi")


def weight_sensitivity(variants: DataFrame, genotypes: DataFrame, membership: DataFrame, groups: DataFrame, schemes: Iterable[str] = tuple(SCHEMES)) -> DataFrame:
    """scheme, pathway, effect_size of the scores that each weight scheme gives. The schemes are columns: genotypes, burdens
    and scores are gone through once for all of them."""
    schemes = list(schemes)
    weights = {s: scheme_weight(F.col("consequence"), F.col("cadd"), s) for s in schemes}
    burden = cut(B.gene_burdens(variants, genotypes, weights))
    labelled = B.mean_scores(burden, membership, groups.select("sample_id"), schemes).join(groups, "sample_id")
    stats = [F.struct(F.lit(s).alias("scheme"), F.count(s).alias("n"), F.avg(s).alias("mean"), F.var_samp(s).alias("var")) for s in schemes]
    each = labelled.groupBy("pathway", "grp").agg(F.array(*stats).alias("s")).select("pathway", "grp", F.inline("s"))
    return I.largest_d(each, ("scheme", "pathway")).select("scheme", "pathway", "effect_size")


def is_robust(values: DataFrame, column: str, threshold: float = 0.1) -> DataFrame:
    """One row: cv (population sd over the absolute mean) and whether it is under threshold."""
    cv = F.try_divide(F.stddev_pop(column), F.abs(F.avg(column)))
    return values.agg(cv.alias("cv")).withColumn("is_robust", F.coalesce(F.col("cv") < threshold, F.lit(False)))


def plausibility(labelled: DataFrame, membership: DataFrame, summary: DataFrame) -> DataFrame:
    """grp, pathway (the most enriched one), genes, pathogenic: how many of its genes have pathogenic variants."""
    top = I.one_against_rest(labelled).groupBy("grp").agg(F.min(F.struct((-F.col("effect_size")).alias("neg"), "pathway")).alias("t"))
    known = X.clinvar_coverage(membership, summary).select("pathway", F.col("n_genes").alias("genes"), F.col("with_pathogenic").alias("pathogenic"))
    return top.select("grp", F.col("t.pathway").alias("pathway")).join(known, "pathway")


def full_validation(spark: SparkSession, membership: DataFrame, summary: DataFrame, reference: DataFrame, n_samples: int = 100, n_subtypes: int = 3, effect: float = 1.0, seed: int = 42) -> dict:
    """Gene sets against reference tables and a cohort simulated from them; passed if sets are covered and the cohort found."""
    coverage = X.clinvar_coverage(membership, summary)
    overlap = X.best_jaccard(membership, reference)
    c = S.clinvar_cohort(spark, membership, summary, n_samples, n_subtypes, effect, seed=seed)
    scores = B.zscores(B.pathway_scores(c.burden, membership, c.truth))
    labels = CL.assign(scores, n_subtypes, seed=seed)
    ari = adjusted_rand(labels.join(c.truth, "sample_id"), "cluster", "truth").first()["ari"]
    labelled = scores.join(labels.select("sample_id", F.col("cluster").cast("string").alias("grp")), "sample_id")
    plausible = plausibility(labelled, membership, summary)
    share = coverage.agg(F.avg("fraction")).first()[0] or 0.0
    distinct = plausible.agg(F.count_distinct("pathway")).first()[0]
    return {
        "mean_coverage": share, "synthetic_ari": ari, "distinct_top_pathways": distinct, "passed": bool(share > 0 and ari >= 0.5),
        "coverage": coverage, "overlap": overlap, "plausibility": plausible,
    }


def compare_all_cohorts(cohorts: dict[str, tuple[DataFrame, DataFrame]], seed: int = 42) -> DataFrame:
    """cohort_a, cohort_b and compare_cohorts of each pair of {name: (scores, labels)}; pairs that can't be are left out."""
    names, out = sorted(cohorts), []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            try:
                row = CL.compare_cohorts(*cohorts[a], *cohorts[b], seed)
            except ValueError:
                continue
            out.append(row.select(F.lit(a).alias("cohort_a"), F.lit(b).alias("cohort_b"), "*"))
    if not out:
        raise ValueError("no pair of cohorts can be compared")
    return reduce(DataFrame.unionByName, out)


def cohort_report(comparisons: DataFrame) -> str:
    lines = ["| cohorts | transfer ARI | projection ARI | r of variances |", "|-|-|-|-|"]
    for r in comparisons.orderBy("cohort_a", "cohort_b").collect():
        lines.append(f"| {r['cohort_a']}, {r['cohort_b']} | {r['transfer_ari']:.3f} | {r['projection_ari']:.3f} | {r['pathway_correlation']:.3f} |")
    return "\n".join(lines)


def write_cohort_report(comparisons: DataFrame, path: str) -> None:
    """The report, with what the figures say, as one text file."""
    from ..pipeline import text

    means = comparisons.agg(F.avg("transfer_ari").alias("t"), F.avg("projection_ari").alias("p")).first()
    found = "replicate" if min(means["t"], means["p"]) >= 0.7 else "replicate in part" if max(means["t"], means["p"]) >= 0.3 else "don't replicate"
    text(comparisons.sparkSession, path, f"# Cohorts\n\n{cohort_report(comparisons)}\n\nOn the mean the subtypes {found}.\n")


def shared_subtypes(a: DataFrame, b: DataFrame, column: str = "cluster_label") -> DataFrame:
    return a.select(column).intersect(b.select(column))


def recovery(labels: DataFrame, predicted: str = "cluster", truth: str = "truth") -> DataFrame:
    """One row: ari, nmi, k_predicted, k_true, correct_k."""
    k = labels.agg(F.count_distinct(predicted).alias("k_predicted"), F.count_distinct(truth).alias("k_true"))
    j = adjusted_rand(labels, predicted, truth).join(F.broadcast(normalized_mutual_information(labels, predicted, truth))).join(F.broadcast(k))
    return j.withColumn("correct_k", F.col("k_predicted") == F.col("k_true"))


def benchmark_sweep(spark: SparkSession, effects: Iterable[float] = (0.5, 1.0, 1.5), sizes: Iterable[int] = (60, 120), n_pathways: int = 15, n_subtypes: int = 3, seed: int = 42) -> DataFrame:
    """effect, n, method, ari, place over a grid of simulated cohorts."""
    out = []
    for e in effects:
        for n in sizes:
            c = S.cohort(spark, n, n_pathways, 10, n_subtypes, effect=e, seed=seed)
            scores = B.zscores(B.pathway_scores(c.burden, c.membership, c.truth))
            found = CL.benchmark(scores, c.burden, n_subtypes, c.truth, seed=seed)
            out.append(found.select(F.lit(float(e)).alias("effect"), F.lit(n).alias("n"), "method", "ari", "place"))
    return reduce(DataFrame.unionByName, out)


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """method, mean_ari, wins."""
    return sweep.groupBy("method").agg(F.avg("ari").alias("mean_ari"), F.count_if(F.col("place") == 1).alias("wins"))


def validate_framework(spark: SparkSession, n: int = 200, d: int = 15, k: int = 3, effect: float = 1.0, n_runs: int = 10, seed: int = 42) -> DataFrame:
    """One row: mean ARI and power on planted clusters, type I error without any."""
    found = CL.power_curve(spark, [(n, effect)], d, k, n_simulations=n_runs, seed=seed).select("mean_ari", "power")
    return found.join(F.broadcast(CL.type_one_error(spark, n, d, k, n_simulations=n_runs, seed=seed)))


def memory_estimate(n_samples: int, n_variants: int, n_genes: int, n_pathways: int) -> dict[str, float]:
    """MB on one node: a byte a genotype, 200 a variant, 8 a burden and a score."""
    parts = {"genotypes": n_samples * n_variants, "variants": 200 * n_variants, "burdens": 8 * n_samples * n_genes, "scores": 8 * n_samples * n_pathways}
    mb = {k: v / 2**20 for k, v in parts.items()}
    return mb | {"total": sum(mb.values())}
