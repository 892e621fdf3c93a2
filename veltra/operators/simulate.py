"""Synthetic cohorts. Random numbers are arithmetic on seed and numbers of samples and genes: the same on every engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .resample import PRIME, mixed


@dataclass(frozen=True)
class Cohort:
    """truth (sample_id, truth), membership (pathway, gene), burden (sample_id, gene, burden)."""

    truth: DataFrame
    membership: DataFrame
    burden: DataFrame


def uniform(seed: int, *ids: Column | str) -> Column:
    """In (0, 1), from whole numbers, mixed one after another."""
    h = F.lit(seed).cast("long")
    for x in ids:
        # Each number is bound once: written out, the expression would grow threefold with every step.
        h = let(let(mixed_once(F.col(x) if isinstance(x, str) else x, h), squared), squared)
    return (h + 0.5) / float(PRIME)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mixed_once(ident: Column, h: Column) -> Column:
    return let(F.struct(ident.alias("i"), h.alias("h")), lambda p: mixed(p["i"], p["h"]))


def squared(h: Column) -> Column:
    """Takes apart numbers whose mixing went side by side, as for neighbouring seeds."""
    return F.pmod(h * h + h * 69621 + 7, F.lit(PRIME))


def normal(seed: int, *ids: Column | str) -> Column:
    """Standard normal, by the Box-Muller transform of two hashes."""
    return F.sqrt(-2 * F.ln(uniform(seed, *ids))) * F.cos(2 * F.pi() * uniform(seed + 1, *ids))


def exponential(scale: float, seed: int, *ids: Column | str) -> Column:
    return -scale * F.ln(uniform(seed, *ids))


def _samples(spark: SparkSession, n: int, proportions: list[float], seed: int) -> DataFrame:
    """Samples numbered from 0 (s) and their subtypes: the first shares of a shuffled order. One window over all samples
    of a simulation, which are a parameter."""
    total, edges, so_far = sum(proportions), [], 0.0
    for p in proportions:
        so_far += p / total
        edges.append(so_far)
    share = (F.percent_rank().over(_by(uniform(seed, "id"))) * (n - 1) + 0.5) / max(1, n)
    truth = F.lit(len(edges) - 1)
    for i in reversed(range(len(edges) - 1)):
        truth = F.when(F.col("share") < edges[i], i).otherwise(truth)
    return spark.range(n).withColumn("share", share).select(F.format_string("S%05d", F.col("id")).alias("sample_id"), F.col("id").alias("s"), truth.alias("truth"))


def _by(column: Column):
    from pyspark.sql import Window

    return Window.orderBy(column)


def cohort(
    spark: SparkSession,
    n_samples: int = 100,
    n_pathways: int = 15,
    genes_per_pathway: int = 20,
    n_subtypes: int = 3,
    effect: float = 1.0,
    noise: float = 1.0,
    proportions: list[float] | None = None,
    n_ancestry: int = 1,
    ancestry_effect: float = 0.0,
    confounding: float = 0.0,
    seed: int = 42,
) -> Cohort:
    """Exponential burdens (scale 0.5), a shift of about effect * noise in the pathways of a sample's subtype, normal
    noise, nothing below 0. With n_ancestry over 1, truth also has ancestry, which shifts all genes and agrees with the
    subtype in a share of samples."""
    truth = _samples(spark, n_samples, proportions or [1.0] * n_subtypes, seed)
    if n_ancestry > 1:
        free = F.floor(uniform(seed + 9, "s") * n_ancestry).cast("int")
        group = F.when(uniform(seed + 8, "s") < confounding, F.col("truth") % n_ancestry).otherwise(free)
        truth = truth.withColumn("ancestry", group)
    pathways = spark.range(n_pathways).select(F.col("id").cast("int").alias("p"), F.format_string("PATHWAY_%02d", F.col("id")).alias("pathway"))
    size = F.greatest(F.lit(5), F.round(F.lit(genes_per_pathway) + 5 * normal(seed + 2, "p"))).cast("int")
    members = pathways.withColumn("n", size).select("p", "pathway", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("g"))
    members = members.select("p", "g", "pathway", F.format_string("G%02d_%03d", F.col("p"), F.col("g")).alias("gene"))
    cells = truth.join(F.broadcast(members))
    shift = F.when(F.col("p") % n_subtypes == F.col("truth"), effect * noise + 0.1 * normal(seed + 4, "s", "p", "g")).otherwise(0.0)
    value = exponential(0.5, seed + 3, "s", "p", "g") + shift + noise * 0.1 * normal(seed + 6, "s", "p", "g")
    if n_ancestry > 1:
        value = value + ancestry_effect * F.col("ancestry") * uniform(seed + 7, "p", "g")
    burden = cells.select("sample_id", "gene", F.greatest(F.lit(0.0), value).alias("burden"))
    return Cohort(truth.drop("s"), members.select("pathway", "gene"), burden)


def expression_cohort(
    spark: SparkSession, n_samples: int = 100, n_genes: int = 200, n_pathways: int = 10, genes_per_pathway: int = 15, n_subtypes: int = 3,
    effect: float = 1.0, noise: float = 1.0, mean: float = 6.0, sd: float = 2.0, dropout: float = 0.05, seed: int = 42,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """expression (sample_id, gene, value), membership and truth: log expression with a shift in a subtype's pathways."""
    truth = _samples(spark, n_samples, [1.0] * n_subtypes, seed)
    genes = spark.range(n_genes).select(F.col("id").alias("g"), F.format_string("GENE%d", F.col("id")).alias("gene"))
    pathway = F.floor(F.col("g") / genes_per_pathway)
    membership = genes.where(pathway < n_pathways).select(F.format_string("PATHWAY_%02d", pathway).alias("pathway"), "gene")
    cells = truth.join(F.broadcast(genes))
    shift = F.when((pathway < n_pathways) & (pathway % n_subtypes == F.col("truth")), effect).otherwise(0.0)
    value = mean + sd * normal(seed + 2, "g") + shift + 0.3 * noise * normal(seed + 3, "s", "g")
    value = F.when(uniform(seed + 5, "s", "g") < dropout, 0.0).otherwise(F.greatest(F.lit(0.0), value))
    return cells.select("sample_id", "gene", value.alias("value")), membership, truth.drop("s")


def clinvar_cohort(spark: SparkSession, membership: DataFrame, summary: DataFrame, n_samples: int = 100, n_subtypes: int = 3, effect: float = 1.0, noise: float = 1.0, seed: int = 42) -> Cohort:
    """Burdens of the given gene sets; a gene's baseline rises with its known pathogenic variants, up to 100 of them."""
    truth = _samples(spark, n_samples, [1.0] * n_subtypes, seed)
    names = {r["pathway"]: i for i, r in enumerate(membership.select("pathway").distinct().orderBy("pathway").collect())}
    ordinal = spark.createDataFrame(list(names.items()), "pathway string, p int")
    known = summary.select(F.upper("symbol").alias("symbol"), "n_pathogenic")
    genes = membership.join(F.broadcast(ordinal), "pathway").join(known, F.upper("gene") == F.col("symbol"), "left")
    base = 0.3 + F.least(F.coalesce("n_pathogenic", F.lit(0)), F.lit(100)) / 100.0 * 0.7
    genes = genes.groupBy("gene").agg(F.collect_set("p").alias("ps"), F.max(base).alias("base"))
    numbers = {r["gene"]: i for i, r in enumerate(membership.select("gene").distinct().orderBy("gene").collect())}
    numbered = spark.createDataFrame(list(numbers.items()), "gene string, g int")
    # A row for each sample and gene is what is asked for; gene sets are few rows.
    cells = truth.crossJoin(F.broadcast(genes.join(F.broadcast(numbered), "gene")))
    mine = F.exists("ps", lambda p: p % n_subtypes == F.col("truth"))
    value = F.col("base") * exponential(0.5, seed + 3, "s", "g") + F.when(mine, effect * noise).otherwise(0.0) + 0.1 * noise * normal(seed + 4, "s", "g")
    return Cohort(truth.drop("s"), membership, cells.select("sample_id", "gene", F.greatest(F.lit(0.0), value).alias("burden")))


def cohort_pair(spark: SparkSession, n_a: int = 100, n_b: int = 80, seed: int = 42, **options) -> tuple[Cohort, Cohort]:
    """Two cohorts of the same subtypes and pathways, with draws of their own."""
    return cohort(spark, n_a, seed=seed, **options), cohort(spark, n_b, seed=seed + 1000, **options)
