"""Pathway scores from expression (sample_id, gene, value), in long form: ssGSEA, GSVA-like walk, mean z."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import d
from ..session import few
from .order import average_ranks


def transform(expression: DataFrame, input_type: str = "tpm") -> DataFrame:
    """log2 stays; counts become log2(x + 1); tpm and fpkm too, if any value is over 20."""
    if input_type == "log2":
        return expression
    logged = F.log2(F.col("value") + 1)
    if input_type == "counts":
        return expression.withColumn("value", logged)
    top = expression.agg(F.max("value").alias("__top"))
    return expression.join(F.broadcast(top)).withColumn("value", F.when(F.col("__top") > 20, logged).otherwise(F.col("value"))).drop("__top")


def filter_genes(expression: DataFrame, min_samples: int = 3) -> DataFrame:
    """Genes that are not all zero, not zero in too many samples and not constant. Rows absent count as nothing."""
    good = expression.groupBy("gene").agg(F.count_if(F.col("value") != 0).alias("n"), F.var_samp("value").alias("v"))
    good = good.where((F.col("n") >= min_samples) & (F.col("v") > 0)).select("gene")
    return expression.join(good, "gene", "left_semi")


def filter_samples(expression: DataFrame, min_genes: int = 1) -> DataFrame:
    """Samples with at least min_genes genes over zero."""
    good = expression.groupBy("sample_id").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= min_genes)
    return expression.join(good.select("sample_id"), "sample_id", "left_semi")


def expression_report(expression: DataFrame, min_genes: int = 1, min_samples: int = 2) -> DataFrame:
    """One row: n_samples, n_kept (with at least min_genes genes over zero), n_genes, pct_zero of the cells, usable: enough
    samples are kept."""
    kept = filter_samples(expression, min_genes).agg(F.count_distinct("sample_id").alias("n_kept"))
    zero = 100.0 * F.count_if(F.col("value") == 0) / F.greatest(F.lit(1), F.count(F.lit(1)))
    whole = expression.agg(F.count_distinct("sample_id").alias("n_samples"), F.count_distinct("gene").alias("n_genes"), zero.alias("pct_zero"))
    return whole.join(F.broadcast(kept)).select("n_samples", "n_kept", "n_genes", "pct_zero", (F.col("n_kept") >= min_samples).alias("usable"))


def members_of(expression: DataFrame, membership: DataFrame, min_genes: int) -> DataFrame:
    genes = expression.select("gene").distinct()
    known = membership.join(genes, "gene").select("pathway", "gene").distinct()
    sizes = known.groupBy("pathway").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_genes)
    return few(known.join(sizes, "pathway"))


def mean_z(expression: DataFrame, membership: DataFrame, min_genes: int = 2) -> DataFrame:
    stats = expression.groupBy("gene").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(d(1e-10))
    z = expression.join(stats, "gene").select("sample_id", "gene", ((F.col("value") - F.col("mu")) / sd).alias("z"))
    joined = z.join(members_of(expression, membership, min_genes), "gene")
    return joined.groupBy("sample_id", "pathway").agg(F.avg("z").alias("score"))


def ssgsea(expression: DataFrame, membership: DataFrame, alpha: float = 0.25, min_genes: int = 2) -> DataFrame:
    """Sum over the walk down the ranks of the hit share less the miss share. Equal ranks go by gene name.

    No walk is needed: a gene at place p of n adds its weight to n - p + 1 of the cumulative sums.
    """
    ranked = average_ranks(expression, ["sample_id"], "value")
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.col("rank").desc(), "gene"))
    left = (F.col("n") - place + 1).cast("double")
    walked = ranked.select("sample_id", "gene", "n", F.pow("rank", d(alpha)).alias("w"), left.alias("left"))
    members = walked.join(members_of(expression, membership, min_genes), "gene")
    sums = members.groupBy("sample_id", "pathway", "n", "size").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("left")).alias("hits"), F.sum("left").alias("left")
    )
    n = F.col("n").cast("double")
    misses = (n * (n + 1) / 2 - F.col("left")) / (n - F.col("size"))
    score = F.when((F.col("n") == F.col("size")) | (F.col("w") == 0), d(0)).otherwise(F.col("hits") / F.col("w") - misses)
    return sums.select("sample_id", "pathway", score.alias("score"))


def gsva(expression: DataFrame, membership: DataFrame, min_genes: int = 2) -> DataFrame:
    """The extreme of the walk down the cumulative distribution of each gene, with its sign; positive on a tie.

    Only the places of a pathway's own genes matter: between them the walk falls, so that its highest points are right
    after a member and its lowest right before one (or at the end, where it is zero).
    """
    by_gene = average_ranks(expression, ["gene"], "value").withColumn("ecdf", F.col("rank") / F.col("n"))
    per_sample = Window.partitionBy("sample_id")
    place = F.row_number().over(per_sample.orderBy(F.col("ecdf").desc(), "gene"))
    placed = by_gene.select("sample_id", "gene", place.alias("place"), F.count(F.lit(1)).over(per_sample).alias("genes"))
    members = placed.join(members_of(expression, membership, min_genes), "gene")
    k = F.row_number().over(Window.partitionBy("sample_id", "pathway").orderBy("place"))
    walk = members.withColumn("k", k)
    miss = F.when(F.col("genes") > F.col("size"), (F.col("place") - F.col("k")) / (F.col("genes") - F.col("size"))).otherwise(d(0))
    after, before = F.col("k") / F.col("size") - miss, (F.col("k") - 1) / F.col("size") - miss
    out = walk.groupBy("sample_id", "pathway").agg(F.greatest(F.max(after), d(0)).alias("hi"), F.least(F.min(before), d(0)).alias("lo"))
    return out.select("sample_id", "pathway", F.when(F.round("hi", 9) >= F.round(-F.col("lo"), 9), F.col("hi")).otherwise(F.col("lo")).alias("score"))
