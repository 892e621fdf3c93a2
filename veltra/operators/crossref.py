"""Gene sets against reference tables: coverage, best Jaccard match, annotation lookup by several keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weights import d
from .set_join import most_similar


def clinvar_coverage(membership: DataFrame, summary: DataFrame) -> DataFrame:
    """pathway, n_genes, in_clinvar, with_pathogenic and their shares; summary (symbol, n_pathogenic) by upper-case symbol."""
    genes = membership.select("pathway", F.upper("gene").alias("gene"))
    known = summary.groupBy(F.upper("symbol").alias("gene")).agg(F.max("n_pathogenic").alias("n_pathogenic"))
    j = genes.join(known, "gene", "left")
    out = j.groupBy("pathway").agg(
        F.count(F.lit(1)).alias("n_genes"), F.count("n_pathogenic").alias("in_clinvar"), F.count_if(F.col("n_pathogenic") > 0).alias("with_pathogenic")
    )
    n = F.greatest(F.lit(1), F.col("n_genes"))
    return out.withColumn("fraction", F.col("in_clinvar") / n).withColumn("pathogenic_fraction", F.col("with_pathogenic") / n)


def best_jaccard(left: DataFrame, right: DataFrame, min_overlap: float = 0.1) -> DataFrame:
    """pathway, match, jaccard of the best of right's sets (of equals the first by name); match is null under min_overlap.
    Both tables are (pathway, gene); genes are compared in upper case."""
    a = left.select("pathway", F.upper("gene").alias("gene")).distinct()
    b = right.select(F.col("pathway").alias("match"), F.upper("gene").alias("gene")).distinct()
    best = most_similar(a, b)
    return best.select("pathway", F.when(F.col("jaccard") >= min_overlap, F.col("match")).alias("match"), "jaccard")


def lookup_by_keys(rows: DataFrame, annotations: DataFrame, keys: list[Column], values: list[str], id_col: str = "variant_id") -> DataFrame:
    """rows with the annotation under the first of keys that has one; annotations (key, *values), one row a key."""
    wanted = rows.select(id_col, F.posexplode(F.array(*keys)).alias("priority", "key")).where("key is not null")
    hits = wanted.join(annotations, "key").groupBy(id_col).agg(F.min(F.struct("priority", *values)).alias("hit"))
    return rows.join(hits, id_col, "left").select(*rows.columns, *[F.col(f"hit.{v}").alias(v) for v in values])


def gene_pathway(membership: DataFrame) -> DataFrame:
    """gene -> the last pathway that has it; membership carries ord, the pathway's place in its file."""
    return membership.groupBy("gene").agg(F.max_by("pathway", "ord").alias("pathway"))


def coverage(membership: DataFrame, genes: DataFrame, min_genes: int = 2) -> DataFrame:
    """One row: covered sets (at least min_genes known genes), all sets, mean share of known genes."""
    j = membership.distinct().join(genes.select("gene").distinct().withColumn("known", F.lit(1)), "gene", "left")
    sets = j.groupBy("pathway").agg(F.count("known").alias("k"), F.count(F.lit(1)).alias("n"))
    return sets.agg(F.count_if(F.col("k") >= min_genes).alias("n_covered"), F.count(F.lit(1)).alias("n_sets"), F.avg(F.col("k") / F.col("n")).alias("mean_coverage"))


# Thresholds by number of samples (rows) and of clusters (2 to 8).
GRID_SAMPLES = (30, 50, 75, 100, 150, 200, 300, 500)
NULL_ARI = {
    2: (0.148, 0.092, 0.061, 0.045, 0.029, 0.022, 0.014, 0.0085),
    3: (0.182, 0.118, 0.078, 0.058, 0.038, 0.028, 0.019, 0.011),
    4: (0.215, 0.142, 0.095, 0.071, 0.047, 0.035, 0.023, 0.014),
    5: (0.248, 0.165, 0.111, 0.083, 0.055, 0.041, 0.027, 0.0165),
    6: (0.279, 0.187, 0.126, 0.095, 0.063, 0.047, 0.031, 0.019),
    7: (0.308, 0.208, 0.14, 0.106, 0.07, 0.053, 0.035, 0.021),
    8: (0.335, 0.228, 0.154, 0.116, 0.077, 0.058, 0.039, 0.023),
}
STABILITY = {
    2: (0.72, 0.81, 0.86, 0.89, 0.92, 0.94, 0.955, 0.97),
    3: (0.65, 0.75, 0.81, 0.85, 0.885, 0.91, 0.935, 0.955),
    4: (0.58, 0.69, 0.76, 0.81, 0.85, 0.88, 0.91, 0.94),
    5: (0.51, 0.63, 0.71, 0.77, 0.815, 0.85, 0.885, 0.92),
    6: (0.45, 0.57, 0.66, 0.73, 0.78, 0.82, 0.86, 0.9),
    7: (0.39, 0.51, 0.61, 0.69, 0.745, 0.79, 0.835, 0.88),
    8: (0.34, 0.46, 0.56, 0.65, 0.71, 0.76, 0.81, 0.86),
}


def threshold_grid(spark) -> DataFrame:
    rows = [(n, k, NULL_ARI[k][i], STABILITY[k][i]) for k in NULL_ARI for i, n in enumerate(GRID_SAMPLES)]
    return spark.createDataFrame(rows, "n int, k int, null_ari double, stability double")


def interpolate_thresholds(points: DataFrame, grid: DataFrame) -> DataFrame:
    """points (n, k) with null_ari and stability, bilinear between the grid's neighbours; null outside the grid."""
    axis = grid.agg(F.sort_array(F.collect_set("n")).alias("ns"), F.sort_array(F.collect_set("k")).alias("ks"))
    p = points.join(F.broadcast(axis))
    lo = lambda axis_, v: F.array_max(F.filter(axis_, lambda x: x <= v))
    hi = lambda axis_, v: F.array_min(F.filter(axis_, lambda x: x >= v))
    p = p.select("n", "k", lo("ns", F.col("n")).alias("n0"), hi("ns", F.col("n")).alias("n1"), lo("ks", F.col("k")).alias("k0"), hi("ks", F.col("k")).alias("k1"))
    tn = F.coalesce(F.try_divide(F.col("n") - F.col("n0"), F.col("n1") - F.col("n0")), d(0))
    tk = F.coalesce(F.try_divide(F.col("k") - F.col("k0"), F.col("k1") - F.col("k0")), d(0))
    corners = [("n0", "k0", (1 - tn) * (1 - tk)), ("n1", "k0", tn * (1 - tk)), ("n0", "k1", (1 - tn) * tk), ("n1", "k1", tn * tk)]
    out = p
    for i, (n, k, _) in enumerate(corners):
        g = F.broadcast(grid.select(F.col("n").alias(f"gn{i}"), F.col("k").alias(f"gk{i}"), F.col("null_ari").alias(f"a{i}"), F.col("stability").alias(f"s{i}")))
        out = out.join(g, (F.col(n) == F.col(f"gn{i}")) & (F.col(k) == F.col(f"gk{i}")), "left")
    mix = lambda c: reduce(lambda a, b: a + b, [w * F.col(f"{c}{i}") for i, (_, _, w) in enumerate(corners)])
    return out.select("n", "k", mix("a").alias("null_ari"), mix("s").alias("stability"))


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last in order; kept while rows are summed up, so that no key's rows meet."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(key, "__last.*").select(*df.columns)
