"""Effect sizes and tests on long scores with a group for each sample: labelled (sample_id, grp, pathway, score).

Everything is sums by pathway and group first; only those few rows meet afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import d
from ..session import cut, few
from .order import average_ranks


def group_stats(labelled: DataFrame, by: tuple[str, ...] = ("pathway",)) -> DataFrame:
    return labelled.groupBy(*by, "grp").agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.var_samp("score").alias("var")
    )


def anova(labelled: DataFrame, by: tuple[str, ...] = ("pathway",)) -> DataFrame:
    """pathway (or all of by), k, n, f_stat and eta2; 0 where there is no spread or are too few groups or samples."""
    return f_statistics(group_stats(labelled, by), by)


def f_statistics(stats: DataFrame, by: tuple[str, ...] = ("pathway",)) -> DataFrame:
    """anova from counts, means and variances (by, grp, n, mean, var)."""
    stats = cut(stats)  # read three times
    total = stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")
    )
    both = stats.withColumnRenamed("n", "ng").join(total.select(*by, "grand"), list(by))
    within = F.when(F.col("ng") > 1, F.col("var") * (F.col("ng") - 1)).otherwise(d(0))
    parts = both.groupBy(*by).agg(
        F.sum(F.col("ng") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"), F.sum(within).alias("ssw")
    )
    out = parts.join(total, list(by))
    usable = (F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("ssw") > 0)
    f = F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k")))
    eta = F.when(F.col("ssb") + F.col("ssw") > 0, F.col("ssb") / (F.col("ssb") + F.col("ssw"))).otherwise(d(0))
    return out.select(*by, "k", "n", F.when(usable, f).otherwise(d(0)).alias("f_stat"), eta.alias("eta2"))


def cohens_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    return F.when((n1 < 2) | (n2 < 2) | (F.coalesce(pooled, d(0)) <= 0), d(0)).otherwise((m1 - m2) / F.sqrt(pooled))


def max_pairwise_d(labelled: DataFrame, by: tuple[str, ...] = ("pathway",)) -> DataFrame:
    """pathway (or all of by), effect_size: the largest absolute d over all pairs of groups."""
    return largest_d(group_stats(labelled, by), by)


def largest_d(stats: DataFrame, by: tuple[str, ...] = ("pathway",)) -> DataFrame:
    """max_pairwise_d from counts, means and variances (by, grp, n, mean, var), which are worked out once."""
    stats = cut(stats)
    a, b = stats.alias("a"), stats.alias("b")
    same = F.col("a.grp") < F.col("b.grp")
    for c in by:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    pairs = a.join(b, same)
    size = F.abs(cohens_d(*[F.col(f"{t}.{c}") for t in "ab" for c in ("n", "mean", "var")]))
    return pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(F.max(size).alias("effect_size"))


def one_against_rest(labelled: DataFrame) -> DataFrame:
    """pathway, grp, n, mean, overall, fold and effect_size of each group against all other samples."""
    sums = labelled.groupBy("pathway", "grp").agg(
        F.count("score").alias("n"), F.sum("score").alias("s"), F.avg("score").alias("mean"), F.var_samp("score").alias("var")
    )
    total = labelled.groupBy("pathway").agg(
        F.count("score").alias("tn"), F.avg("score").alias("tmean"), F.var_samp("score").alias("tvar")
    )
    j = sums.join(few(total), "pathway")
    n, m, v, tn, tm, tv = (F.col(c) for c in ("n", "mean", "var", "tn", "tmean", "tvar"))
    rn = tn - n
    rm = F.try_divide(tn * tm - n * m, rn)
    # Sums of squares about the mean add up: total = group + rest + between.
    rss = tv * (tn - 1) - F.coalesce(v, d(0)) * (n - 1) - F.try_divide(n * rn, tn) * F.pow(m - rm, 2)
    rv = F.try_divide(F.greatest(rss, d(0)), rn - 1)
    fold = F.when(tm != 0, F.try_divide(m, tm)).when(m != 0, F.lit(float("inf"))).otherwise(d(1))
    return j.select("pathway", "grp", "n", m.alias("mean"), tm.alias("overall"), fold.alias("fold"), cohens_d(n, m, v, rn, rm, rv).alias("effect_size"))


def kruskal_wallis(labelled: DataFrame) -> DataFrame:
    """pathway, h, df: tie-corrected; groups under two samples are left out. h is null where all values are equal."""
    # Equal scores of a group are one row; what comes after it reads such rows, and ranks them once.
    counted = cut(labelled.groupBy("pathway", "grp", "score").agg(F.count(F.lit(1)).alias("c")))
    big = counted.groupBy("pathway", "grp").agg(F.sum("c").alias("ng")).where("ng >= 2")
    ranked = average_ranks(counted.join(few(big.select("pathway", "grp")), ["pathway", "grp"], "left_semi"), ["pathway"], "score", "c")
    # A sample in a tie of t adds t * t - 1; over the tie that is t ** 3 - t.
    tie = F.sum(F.col("c") * (F.col("ties").cast("double") * F.col("ties") - 1)).alias("tie")
    by_group = cut(ranked.groupBy("pathway", "grp").agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("ng"), tie))
    sums = by_group.groupBy("pathway").agg(
        F.sum(F.col("r") * F.col("r") / F.col("ng")).alias("q"), F.sum("ng").cast("double").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("tie").alias("tie")
    )
    n = F.col("n")
    h = d(12) / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return sums.select("pathway", F.try_divide(h, 1 - F.col("tie") / (n * n * n - n)).alias("h"), (F.col("k") - 1).alias("df"))


def benjamini_hochberg(tests: DataFrame, monotone: bool = True, by: list[str] | None = None) -> DataFrame:
    """tests (pathway, p) with q; ties go by pathway. Without monotone the step that makes q rise with p is left out."""
    by = by or []
    order = [F.col("p"), F.col("pathway")]
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    raw = F.col("p") * n / F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    with_raw = tests.withColumn("__raw", raw)
    q = F.col("__raw")
    if monotone:
        back = Window.partitionBy(*by).orderBy(F.col("p").desc(), F.col("pathway").desc())
        q = F.min("__raw").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return with_raw.withColumn("q", F.least(q, d(1))).drop("__raw")


def pearson_matrix(scores: DataFrame, pcs: DataFrame) -> DataFrame:
    """pathway, pc, r over common samples (three at least)."""
    joined = scores.join(pcs, "sample_id")
    out = joined.groupBy("pathway", "pc").agg(F.corr("score", "value").alias("r"), F.count(F.lit(1)).alias("n"))
    return out.where("n >= 3").select("pathway", "pc", "r")


def regress_out_one(scores: DataFrame, covariate: DataFrame) -> DataFrame:
    """Residuals of a simple regression on covariate (sample_id, x), as z-scores, and its r2."""
    joined = scores.join(covariate, "sample_id")
    fit = joined.groupBy("pathway").agg(
        F.regr_slope("score", "x").alias("slope"), F.regr_intercept("score", "x").alias("icept"), F.regr_r2("score", "x").alias("r2")
    )
    residual = F.col("score") - F.col("icept") - F.col("slope") * F.col("x")
    left = joined.join(few(fit), "pathway").withColumn("res", residual)
    stats = left.groupBy("pathway").agg(F.avg("res").alias("mu"), F.stddev_samp("res").alias("sd"))
    z = (F.col("res") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(d(1))
    return left.join(few(stats), "pathway").select("sample_id", "pathway", z.alias("score"), F.greatest(F.col("r2"), d(0)).alias("r2"))
