"""Agreement of labelings and quality of clusterings, by sums over contingency tables and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import d
from ..session import cut
from . import mlkit as K


def contingency(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: ari; 1 where it is 0/0. Sums of pairs over the table and both its margins."""
    pairs = F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)
    table = contingency(labels, a, b)
    sides = table.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs.alias("rows")), table.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs.alias("cols"))
    j = table.agg(pairs.alias("both"), F.sum("n").cast("double").alias("n")).join(F.broadcast(sides[0])).join(F.broadcast(sides[1]))
    expected = F.coalesce(F.try_divide(F.col("rows") * F.col("cols"), F.col("n") * (F.col("n") - 1) / 2), d(0))
    most = (F.col("rows") + F.col("cols")) / 2
    return j.select(F.coalesce(F.try_divide(F.col("both") - expected, most - expected), d(1)).alias("ari"))


def normalized_mutual_information(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: nmi by the mean of the entropies; 1 where both are constant."""
    table = contingency(labels, a, b)
    total = table.agg(F.sum("n").cast("double").alias("t"))
    entropy = lambda c: table.groupBy(c).agg(F.sum("n").cast("double").alias("m")).join(F.broadcast(total)).agg(
        (-F.sum(F.col("m") / F.col("t") * F.ln(F.col("m") / F.col("t")))).alias(f"h{c}")
    )
    hxy = table.join(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t")))).alias("hxy"))
    j = hxy.join(F.broadcast(entropy("a"))).join(F.broadcast(entropy("b")))
    nmi = F.try_divide(F.col("ha") + F.col("hb") - F.col("hxy"), (F.col("ha") + F.col("hb")) / 2)
    return j.select(F.coalesce(nmi, d(1)).alias("nmi"))


def centroids(points: DataFrame) -> DataFrame:
    """points (id, features, label) -> label, n, features: means by dimension, combined from partial sums."""
    long = points.select("label", F.posexplode("features").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(F.max("n").alias("n"), F.transform(ordered, lambda p: p["m"]).alias("features"))


def squared_distance(x, y):
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), d(0), lambda s, v: s + v)


def nearest_centroid(points: DataFrame, centres: DataFrame) -> DataFrame:
    """id, label of the nearest centre (the smallest label of equals), distance. centres are few: one array for all."""
    table = centres.agg(F.array_sort(F.collect_list(F.struct("label", "features"))).alias("centres"))
    near = F.transform("centres", lambda c: F.struct(squared_distance(F.col("features"), c["features"]).alias("d2"), c["label"].alias("label")))
    best = points.join(F.broadcast(table)).select("id", F.array_min(near).alias("best"))
    return best.select("id", F.col("best.label").alias("label"), F.sqrt("best.d2").alias("distance"))


def cluster_quality(points: DataFrame) -> DataFrame:
    """One row: calinski_harabasz and davies_bouldin of points (id, features, label)."""
    own = centroids(points)
    joined = points.join(F.broadcast(own.select("label", F.col("features").alias("c"))), "label")
    d2 = squared_distance(F.col("features"), F.col("c"))
    inside = joined.groupBy("label").agg(F.sum(d2).alias("ssw"), F.avg(F.sqrt(d2)).alias("s"))
    stats = own.join(inside, "label")
    grand = centroids(points.withColumn("label", F.lit(0))).select(F.col("features").alias("g"), F.col("n").alias("total"))
    ch = stats.join(F.broadcast(grand)).agg(
        F.sum(F.col("n") * squared_distance(F.col("features"), F.col("g"))).alias("ssb"),
        F.sum("ssw").alias("ssw"), F.count(F.lit(1)).alias("k"), F.max("total").alias("total"),
    )
    x, y = stats.alias("x"), stats.alias("y")
    between = F.sqrt(squared_distance(F.col("x.features"), F.col("y.features")))
    worst = x.join(y, F.col("x.label") != F.col("y.label")).groupBy("x.label").agg(F.max((F.col("x.s") + F.col("y.s")) / between).alias("r"))
    db = worst.agg(F.avg("r").alias("davies_bouldin"))
    value = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("total") - F.col("k")))
    return ch.select(value.alias("calinski_harabasz")).join(F.broadcast(db))


def silhouette(points: DataFrame, block: int = 2048) -> DataFrame:
    """id, silhouette with plain distances: every point against all. Null features have 0, and count for none.

    About ``block`` points are a matrix, and four times as many one that they are compared with: a pair of such matrices
    gives a sum for each point and label, not a row for each pair of points. The work grows with the square of the number
    of points, as the measure's definition does; a task holds two matrices.
    """
    spark, known = points.sparkSession, F.col("features").isNotNull()
    points = cut(points.select("id", "label", F.col("features").cast("array<double>").alias("features")))
    sizes = {r["label"]: r["n"] for r in points.where(known).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes, key=lambda v: (v is None, v))
    codes, n = spark.createDataFrame([(i, v) for i, v in enumerate(names)], f"code int, l {points.schema['label'].dataType.simpleString()}"), sum(sizes.values())
    size, k, mean = np.array([sizes[v] for v in names], float), len(names), None
    if n:
        found = points.where(known).select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()
        mean = np.array([r["m"] for r in sorted(found, key=lambda r: r["i"])])
    coded = points.where(known).join(F.broadcast(codes), F.col("label").eqNullSafe(F.col("l"))).select("id", "code", "features")

    def packed(each: int, name: str) -> DataFrame:
        number = max(1, -(-n // each))
        rows = coded.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(number)))
        return rows.groupBy("b").agg(F.collect_list(F.struct("id", "code", "features")).alias(name)).select(name)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, other = (batch.column(c).slice(row, 1).flatten() for c in (0, 1))
                x, of = (np.asarray(c.field("features").flatten(), float).reshape(len(c), -1) - mean for c in (one, other))
                found = K.distance_sums(x, of, np.eye(k)[np.asarray(other.field("code"))])
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, k, dtype=np.int32), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([one.field("id"), one.field("code"), lists], ["id", "code", "s"])

    key = points.schema["id"].dataType.simpleString()
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "4")  # a row is two matrices
    try:
        tasks = 2 * spark.sparkContext.defaultParallelism
        pairs = packed(block, "one").repartition(tasks).crossJoin(packed(4 * block, "other").coalesce(2))
        parts = cut(pairs.mapInArrow(sums, f"id {key}, code int, s array<double>"))
    finally:
        conf.set(name, before)
    total = F.element_at(F.array(*[F.lit(float(v)) for v in size]), F.col("l") + 1) if k else F.lit(None).cast("double")
    by_label = parts.select("id", "code", F.posexplode("s").alias("l", "s")).groupBy("id", "code", "l").agg(F.sum("s").alias("s"))
    own = F.max(F.when(F.col("l") == F.col("code"), F.when(total > 1, F.col("s") / (total - 1)).otherwise(d(-1))))
    other = F.min(F.when(F.col("l") != F.col("code"), F.col("s") / total))
    ab = by_label.groupBy("id").agg(own.alias("a"), other.alias("b"))
    s = F.when(F.col("a") < 0, d(0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), d(0)))
    return ab.select("id", s.alias("silhouette")).unionByName(points.where(~known).select("id", d(0).alias("silhouette")))


def profiles(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, n, share, pathway, mean_score: the size of each cluster and its mean scores."""
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.join(F.broadcast(labels.agg(F.count(F.lit(1)).alias("total"))))  # one row
    means = scores.join(labels, "sample_id").groupBy("cluster", "pathway").agg(F.avg("score").alias("mean_score"))
    return means.join(sizes, "cluster").select("cluster", "n", (F.col("n") / F.col("total")).alias("share"), "pathway", "mean_score")


def with_truth(assignments: DataFrame, truth: DataFrame, column: str = "planted_subtype") -> DataFrame:
    """All assignments, with what is planted where it is known."""
    return assignments.join(truth.select("sample_id", column), "sample_id", "left")
