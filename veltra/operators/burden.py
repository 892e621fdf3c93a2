"""Gene burdens and pathway scores in long form.

variants (variant_id, gene, consequence, cadd), genotypes (variant_id, sample_id, dosage), membership (pathway, gene),
burden (sample_id, gene, burden), scores (sample_id, pathway, score). Absent burdens are zero; a gene listed twice in a
pathway counts twice. Gene sets and the list of pathways are small: they are broadcast only under BROADCAST_ROWS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weights import d, pipeline_weight
from ..session import broadcast_if_small, cut, few
from .order import average_ranks, percentiles

BROADCAST_ROWS = 1_000_000


def gene_burden(variants: DataFrame, genotypes: DataFrame, weight: Column | None = None) -> DataFrame:
    """Sum of dosage times weight for each sample and gene; rows without gene or dosage don't count."""
    w = pipeline_weight(F.col("consequence"), F.col("cadd")) if weight is None else weight
    return gene_burdens(variants, genotypes, {"burden": w})


def gene_burdens(variants: DataFrame, genotypes: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """gene_burden for several weights, a column for each."""
    own = [w.alias(f"__{i}") for i, w in enumerate(weights.values())]
    weighted = variants.where("gene is not null and gene != ''").select("variant_id", "gene", *own)
    carried = genotypes.where("dosage > 0").join(weighted, "variant_id")
    return carried.groupBy("sample_id", "gene").agg(*[F.sum(F.col("dosage") * F.col(f"__{i}")).alias(name) for i, name in enumerate(weights)])


def known_membership(membership: DataFrame, genes: DataFrame, min_genes: int = 2) -> DataFrame:
    """(pathway, gene, n): members among the known genes, of pathways that have at least min_genes of them."""
    known = membership.join(genes.select("gene").distinct(), "gene")
    sizes = known.groupBy("pathway").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_genes)
    return known.join(sizes, "pathway")


def on_all_samples(sums: DataFrame, samples: DataFrame, pathways: DataFrame, value: str) -> DataFrame:
    """One row for each sample and pathway, null where sums has none. The names go to the samples as one row."""
    names = pathways.select("pathway").distinct().agg(F.collect_list("pathway").alias("__names"))
    axis = samples.select("sample_id").distinct().join(F.broadcast(names))
    grid = axis.select("sample_id", F.explode("__names").alias("pathway"))
    return grid.join(sums.select("sample_id", "pathway", value), ["sample_id", "pathway"], "left")


def pathway_scores(burden: DataFrame, membership: DataFrame, samples: DataFrame, method: str = "mean", min_genes: int = 2) -> DataFrame:
    """Scores of all samples: mean, size_normalized (mean over the root of the number of genes) or median of the burdens.
    burden is read twice: materialise it first."""
    if method != "median":
        return mean_scores(burden, membership, samples, ["burden"], method, min_genes).withColumnRenamed("burden", "score")
    known = cut(known_membership(membership, burden, min_genes))  # read three times
    members = broadcast_if_small(known, BROADCAST_ROWS)
    joined = burden.join(members, "gene")
    # Zeros that aren't stored come first: the median is at fixed places among the stored values.
    stored = joined.groupBy("sample_id", "pathway", "n").agg(F.array_sort(F.collect_list("burden")).alias("v"))
    at = lambda i: F.when(i < 0, d(0)).otherwise(F.get("v", i))
    zeros = (F.col("n") - F.size("v")).cast("int")
    low, high = ((F.col("n") - 1) / 2).cast("int"), (F.col("n") / 2).cast("int")
    sums = stored.select("sample_id", "pathway", ((at(low - zeros) + at(high - zeros)) / 2).alias("score"))
    out = on_all_samples(sums, samples, known, "score")
    return out.select("sample_id", "pathway", F.coalesce("score", d(0)).alias("score"))


def mean_scores(burden: DataFrame, membership: DataFrame, samples: DataFrame, columns: list[str], method: str = "mean", min_genes: int = 2) -> DataFrame:
    """sample_id, pathway and columns: scores of all samples from each of the columns of burden, by mean or size_normalized.
    A zero for each sample and pathway is added up with the burdens, so that nothing has to be joined."""
    known = cut(known_membership(membership, burden, min_genes))  # read twice
    # Numbers instead of names, since each burden meets them.
    pathways = cut(known.select("pathway", "n").distinct().withColumn("__p", F.monotonically_increasing_id()))
    members = cut(known.join(pathways, ["pathway", "n"]).select("gene", "__p"))
    carried = burden.where("sample_id is not null").join(broadcast_if_small(members, BROADCAST_ROWS), "gene")
    numbers = pathways.agg(F.collect_list("__p").alias("__numbers"))
    axis = samples.select("sample_id").distinct().join(F.broadcast(numbers)).select("sample_id", F.explode("__numbers").alias("__p"))
    axis = axis.select("sample_id", "__p", F.lit(True).alias("__there"), *[d(0).alias(c) for c in columns])
    rows = carried.select("sample_id", "__p", F.lit(False).alias("__there"), *columns).unionByName(axis)
    sums = rows.groupBy("sample_id", "__p").agg(F.max("__there").alias("__there"), *[F.sum(c).alias(c) for c in columns]).where("__there")
    named = sums.join(broadcast_if_small(pathways, BROADCAST_ROWS), "__p")
    size = F.col("n") if method == "mean" else F.col("n") * F.sqrt(F.col("n").cast("double"))
    return named.select("sample_id", "pathway", *[(F.col(c) / size).alias(c) for c in columns])


def column_stats(scores: DataFrame) -> DataFrame:
    """A row for each pathway: mu, sd (n - 1), lo, hi. Partial sums are combined, so a pathway is never one task's input."""
    return scores.groupBy("pathway").agg(
        F.avg("score").alias("mu"), F.stddev_samp("score").alias("sd"), F.min("score").alias("lo"), F.max("score").alias("hi")
    )


def with_stats(scores: DataFrame, stats: DataFrame, on: str | list[str] = "pathway") -> DataFrame:
    """Join summary rows back: one a pathway, or a pathway and group, broadcast after a check of their number."""
    return scores.join(few(stats, BROADCAST_ROWS), on)


def drop_constant(scores: DataFrame) -> DataFrame:
    stats = column_stats(scores)
    return scores.join(few(stats.where("sd > 0").select("pathway"), BROADCAST_ROWS), "pathway", "left_semi")


def zscores(scores: DataFrame) -> DataFrame:
    """(x - mean) / sd with n - 1; pathways without spread are dropped."""
    joined = with_stats(scores, column_stats(scores).where("sd > 0"))
    return joined.select("sample_id", "pathway", ((F.col("score") - F.col("mu")) / F.col("sd")).alias("score"))


def normalise(scores: DataFrame, method: str) -> DataFrame:
    """zscore, minmax, robust or rank; a pathway without spread stays as it is (rank: its average rank)."""
    x = F.col("score")
    if method == "zscore":
        out = with_stats(scores, column_stats(scores)).withColumn("v", F.when(F.col("sd") > 0, (x - F.col("mu")) / F.col("sd")).otherwise(x))
    elif method == "minmax":
        span = F.col("hi") - F.col("lo")
        out = with_stats(scores, column_stats(scores)).withColumn("v", F.when(span > 0, (x - F.col("lo")) / span).otherwise(x))
    elif method == "robust":
        q = percentiles(scores, ["pathway"], "score", [0.25, 0.5, 0.75]).drop("n")
        span = F.col("q")[2] - F.col("q")[0]
        out = with_stats(scores, q).withColumn("v", F.when(span > 0, (x - F.col("q")[1]) / span).otherwise(x))
    elif method == "rank":
        out = average_ranks(scores, ["pathway"], "score").withColumn("v", F.col("rank") / F.col("n"))
    else:
        raise ValueError(f"unknown normalisation {method}")
    return out.select("sample_id", "pathway", F.col("v").alias("score"))


def top_pathway(scores: DataFrame) -> DataFrame:
    """The pathway with the largest score of each sample; of equals the first by name."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("pathway").alias("p")))
    out = scores.groupBy("sample_id").agg(best.alias("b"))
    return out.select("sample_id", F.col("b.p").alias("top_pathway"), (-F.col("b.s")).alias("top_score"))
