"""What sets subtypes apart: enriched pathways in order and the genes that contribute most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf
from ..functions.weights import d
from ..session import cut, few
from .inference import benjamini_hochberg, kruskal_wallis, one_against_rest


def enrichment_order(rest: DataFrame) -> DataFrame:
    """place: from 1 in each group by falling absolute effect size, equals by name."""
    order = Window.partitionBy("grp").orderBy(F.round(F.abs("effect_size"), 9).desc(), "pathway")
    return rest.withColumn("place", F.row_number().over(order))


def enrichment(labelled: DataFrame, alpha: float = 0.05) -> DataFrame:
    """one_against_rest with p and q of the Kruskal-Wallis test over the groups, significant, place. p is 1 where the test isn't defined."""
    labelled = cut(labelled)
    h = kruskal_wallis(labelled).withColumn("p", F.when(F.col("df") >= 1, chi2_sf(F.col("h"), F.col("df").cast("double"))))
    p = F.coalesce(F.when(~F.isnan("p"), F.col("p")), d(1))
    q = benjamini_hochberg(h.select("pathway", p.alias("p")))
    out = enrichment_order(one_against_rest(labelled)).join(few(q), "pathway", "left").na.fill(1.0, ["p", "q"])
    return out.withColumn("significant", F.col("q") < alpha)


def gene_contributions(burden: DataFrame, groups: DataFrame, top_n: int = 20) -> DataFrame:
    """grp, gene, mean, overall, fold, effect_size, place of the top_n genes of each group, by their burdens.

    Zero burdens aren't stored: sums over the stored ones and the sizes of the groups give means and variances over all.
    """
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("tn"))
    x = F.col("burden")
    sums = burden.join(groups, "sample_id").groupBy("gene", "grp").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    axis = sums.select("gene").distinct().join(F.broadcast(sizes))
    full = axis.join(sums, ["gene", "grp"], "left").na.fill(0.0, ["s", "ss"])
    whole = full.groupBy("gene").agg(F.sum("s").alias("ts"), F.sum("ss").alias("tss")).join(F.broadcast(total))
    j = full.join(whole, "gene")
    n, s, ss, rn, rs, rss = F.col("n"), F.col("s"), F.col("ss"), F.col("tn") - F.col("n"), F.col("ts") - F.col("s"), F.col("tss") - F.col("ss")
    var = lambda n_, s_, ss_: F.try_divide(ss_ - F.try_divide(s_ * s_, n_), n_ - 1)
    from .inference import cohens_d

    m, rm, overall = F.try_divide(s, n), F.try_divide(rs, rn), F.col("ts") / F.col("tn")
    fold = F.when(overall != 0, F.try_divide(m, overall)).otherwise(d(1))
    rows = j.select("grp", F.col("gene").alias("pathway"), m.alias("mean"), overall.alias("overall"), fold.alias("fold"), cohens_d(n, m, var(n, s, ss), rn, rm, var(rn, rs, rss)).alias("effect_size"))
    return enrichment_order(rows).where(F.col("place") <= top_n).withColumnRenamed("pathway", "gene")


def heatmap(labelled: DataFrame) -> DataFrame:
    """Mean scores, a row for each group and a column for each pathway."""
    names = sorted(r["pathway"] for r in labelled.select("pathway").distinct().collect())  # the columns; given, they have no limit
    return labelled.groupBy("grp").pivot("pathway", names).agg(F.avg("score"))


def top_variance(scores: DataFrame, n: int = 10) -> DataFrame:
    """pathway, variance, place of the n pathways of largest variance, equals by name."""
    found = scores.groupBy("pathway").agg(F.var_samp("score").alias("variance"))
    order = Window.orderBy(F.round("variance", 9).desc(), "pathway")  # a row a pathway
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
