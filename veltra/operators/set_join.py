"""For each set of one table the most similar set of another, without meeting all that have something in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import d
from ..session import broadcast_if_small, cut

BROADCAST_ROWS = 100_000
#: Rarest genes of a set that are looked up first, and how many times more in each round after it.
FIRST, MORE = 2, 4
SLACK = 1e-9


def _ordered(sets: DataFrame, key: str, rarity: DataFrame) -> DataFrame:
    """(key, genes): the known genes of each set, the rarest first. A set's genes are one array."""
    known = sets.join(broadcast_if_small(rarity, BROADCAST_ROWS), "gene")
    listed = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("df", "gene"))).alias("v"))
    return listed.select(key, F.col("v.gene").alias("genes"))


def most_similar(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (pathway, gene), right (match, gene), rows distinct -> pathway, match, jaccard: the set of right with the largest
    Jaccard similarity, of equals the first by name; null and 0 where no gene is in any.

    Genes are looked up in right from the rarest on, some of each set in each round. With t, the best similarity so far:
    - a set as good has t * |A| genes of A, so that one of them is among the first |A| - t * |A| + 1: when these have been
      looked up, the set is done;
    - its size is from t * |A| to |A| / t;
    - met at place i of A and j of B, with nothing in common before, they share one gene and what is left of either.
    Only pairs that may reach t are compared. Hot genes are looked up last, and by few sets.
    """
    rarity = cut(right.groupBy("gene").agg(F.count(F.lit(1)).alias("df")))
    sizes = left.groupBy("pathway").agg(F.count(F.lit(1)).alias("na"))
    known = _ordered(left, "pathway", rarity)
    a = cut(sizes.join(known, "pathway", "left").select("pathway", "na", F.coalesce("genes", F.array().cast(known.schema["genes"].dataType)).alias("genes")))
    b = cut(_ordered(right, "match", rarity).withColumn("nb", F.size("genes")))
    postings = cut(b.select("match", "nb", F.posexplode("genes").alias("j", "gene")))
    k, t, name = F.col("k"), F.col("t"), left.schema["pathway"].dataType
    best = cut(a.select("pathway", "na", F.size("genes").alias("k"), d(0).alias("t"), F.lit(None).cast(name).alias("match"), F.lit(0).alias("probed")))
    needed = F.when(t > 0, k - F.ceil(t * F.col("na") - SLACK) + 1).otherwise(k)
    width = FIRST
    while True:
        round_ = best.withColumn("to", F.least(needed, F.col("probed") + width).cast("int"))
        open_ = round_.where(F.col("to") > F.col("probed"))
        if not open_.limit(1).count():
            break
        genes = open_.join(a.select("pathway", "genes"), "pathway")
        probes = genes.select("pathway", "na", "k", "t", "probed", F.posexplode(F.slice("genes", F.col("probed") + 1, F.col("to") - F.col("probed"))).alias("at", "gene"))
        shared = 1 + F.least(k - 1 - F.col("probed") - F.col("at"), F.col("nb") - 1 - F.col("j"))
        within = (F.col("nb") >= t * F.col("na") - SLACK) & (F.col("nb") * t <= F.col("na") + SLACK)
        pairs = probes.join(postings, "gene").where(within & (shared >= t * (F.col("na") + F.col("nb") - shared) - SLACK)).select("pathway", "match").distinct()
        both = pairs.join(a.alias("a"), "pathway").join(b.alias("b"), "match")
        common = F.size(F.array_intersect("a.genes", "b.genes"))
        scored = both.select("pathway", "match", (common / (F.col("na") + F.col("nb") - common)).alias("j"))
        found = scored.groupBy("pathway").agg(F.min(F.struct((-F.col("j")).alias("neg"), "match")).alias("new"))
        old = F.when(F.col("match").isNotNull(), F.struct((-t).alias("neg"), F.col("match").alias("match")))
        merged = round_.join(found, "pathway", "left").withColumn("now", F.least(old, F.col("new")))  # least skips nulls
        best = cut(
            merged.select("pathway", "na", "k", F.coalesce(-F.col("now.neg"), d(0)).alias("t"), F.col("now.match").alias("match"), F.greatest("to", "probed").alias("probed"))
        )
        width *= MORE
    return best.select("pathway", "match", t.alias("jaccard"))
