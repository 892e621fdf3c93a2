"""Exact k-means on integer vectors, with bounds that spare most distances.

The state of a vector is its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to
each centroid. Each assignment is one pass of Arrow batches over the table of the one before; there is no shuffle, so that
no vector, however often it occurs, gathers in one task. With the new centroids a pass gets how far each moved: upper
bounds grow by that, lower bounds shrink. Then, for vector x in cluster a,

- nothing is looked at if the upper bound is less than half the distance from a to the centroid nearest to it;
- centroid c is passed over if the lower bound to c, or half the distance from a to c, is more than the upper bound.

All comparisons are strict and all bounds are rounded away from skipping, so that a centroid that might be as near is
always measured: distances are 64-bit integers, and of equals the smaller number wins. Each task adds up count, sum and
distances of each cluster in integers; the driver gets those of all tasks together, a row a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_dir, remove, table, written

#: Integers up to this have squared distances that fit in 64 bits, for up to 64 components.
LARGEST = 1 << 27
#: Far more than the rounding of a root, a sum or a difference.
SLACK = 1e-12

STATE = "id long, v array<int>, cluster int, distance long, upper double, lower array<float>, n long, sums array<long>, spread long, measured long"
_STATE = pa.schema(
    [("id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("upper", pa.float64())]
    + [("lower", pa.list_(pa.float32())), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("spread", pa.int64()), ("measured", pa.int64())]
)


def integers(vec: Column) -> Column:
    """floor(256 * x) of each component, x as double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * 256).cast("int"))


def usable(vec: Column, dim: int) -> Column:
    return (F.size(vec) == dim) & F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) * 256 <= F.lit(float(LARGEST)), F.lit(False)))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width).astype(kind)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def _over(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def _under(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def _narrow(lower: np.ndarray) -> np.ndarray:
    """32-bit numbers that aren't more."""
    out = np.maximum(lower, 0).astype(np.float32)
    return np.where(out > lower, np.nextafter(out, np.float32(-1)), out)


class Centres:
    """Centroids, how far they are from each other at least, and how far each moved at most."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, self.k = at, len(at)
        self.half = np.array([_under(_squared(at, c)) for c in at]) / 2
        others = self.half + np.diag(np.full(self.k, np.inf))
        self.nearest = others.min(axis=1)
        self.moved = _over(_squared(at, before)) if before is not None else None

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """cluster, upper, lower of vectors without bounds, and how many distances were measured."""
        squared = np.column_stack([_squared(x, c) for c in self.at])
        cluster = squared.argmin(axis=1)  # the first of equals
        return cluster, _over(squared[np.arange(len(x)), cluster]), _under(squared), squared.size

    def next(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        cluster, lower = cluster.copy(), (lower - self.moved) * (1 - SLACK)
        upper = (upper + self.moved[cluster]) * (1 + SLACK)
        open_ = np.flatnonzero(~(upper < self.nearest[cluster]))
        squared = _squared(x[open_], self.at[cluster[open_]])
        upper[open_], lower[open_, cluster[open_]] = _over(squared), _under(squared)
        measured = len(open_)
        for c in range(self.k):
            own, limit = cluster[open_], upper[open_]
            which = np.flatnonzero((own != c) & ~(lower[open_, c] > limit) & ~(self.half[own, c] > limit))
            rows = open_[which]
            found = _squared(x[rows], self.at[c])
            lower[rows, c] = _under(found)
            measured += len(rows)
            nearer = (found < squared[which]) | ((found == squared[which]) & (c < cluster[rows]))
            rows, which, found = rows[nearer], which[nearer], found[nearer]
            cluster[rows], squared[which], upper[rows] = c, found, _over(found)
        return cluster, upper, lower, measured


def _pass(centres: Centres, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, v), or the state: the next state, and at the end of the task a row with sums for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = centres.k
        n, sums, spread, measured = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim, np.int64)
            if centres.moved is None:
                cluster, upper, lower, count = centres.first(x)
            else:
                cluster, upper = np.asarray(batch.column(2)).astype(np.int64), np.asarray(batch.column(3))
                cluster, upper, lower, count = centres.next(x, cluster, upper, _matrix(batch.column(4), k, np.float64))
            distance = _squared(x, centres.at[cluster])
            measured += count
            n += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, x)
            np.add.at(spread, cluster, distance)
            bounds = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, pa.array(_narrow(lower).ravel()))
            known = [batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(upper), bounds]
            known += [pa.nulls(len(x), f.type) for f in list(_STATE)[6:]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(known, _STATE, strict=True)], schema=_STATE)
        rows = [{"cluster": c, "n": int(n[c]), "sums": sums[c].tolist(), "spread": int(spread[c]), "measured": measured if c == 0 else 0} for c in range(k)]
        yield pa.RecordBatch.from_pylist(rows, schema=_STATE)

    return run


def _summed(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """count, sums and spread of each cluster over all tasks, and how many distances were measured: k rows to the driver."""
    parts = [F.sum("n"), F.sum("spread"), F.sum("measured"), *(F.sum(F.get("sums", F.lit(j))) for j in range(dim))]
    rows = state.where("n is not null").groupBy("cluster").agg(*parts).collect()
    n, spread, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    for c, own, apart, _, *total in rows:
        n[c], spread[c], sums[c] = own, apart, total
    return n, sums, spread, sum(r[3] for r in rows)


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 40, dim: int = 64, rounds: int = 5, seed: int = 2, report: list | None = None
) -> DataFrame:
    """A row for each kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of dim components, none null, nor not finite, nor more than 2**19 in absolute value: beyond that
    distances of these integers don't fit in 64 bits. The first centroids are the k kept vectors with the smallest
    sha256 of "seed:id"; rows that repeat an id go by their components; rows without an id are clustered but start no
    centroid. With fewer than k vectors there are fewer centroids, with none no rows. Other columns are not read.

    report: a list that gets (distances measured, distances without bounds) of each assignment.
    """
    spark = vectors.sparkSession
    if dim > 64:
        raise ValueError("distances of vectors over 64 components need not fit in 64 bits")
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(usable(F.col("v"), dim)).select("id", integers(F.col("v")).alias("v"))
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = [r["v"] for r in kept.where("id is not null").orderBy(by_hash, "v").limit(k).collect()]
    names = (id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    if not start:
        none = kept.where(F.lit(False)).select("id", F.lit(0), *[F.lit(0).cast("long")] * 3, F.lit(""))
        return none.toDF(*names)
    centres, source, path = Centres(np.array(start, np.int64)), kept, None
    for i in range(rounds + 1):
        before, path = path, new_dir(spark, "clusters")
        state = written(source.mapInArrow(_pass(centres, dim), STATE), "clusters", path)
        if before:
            remove(spark, before)
        n, sums, spread, measured = _summed(state, centres.k, dim)
        if report is not None:
            report.append((measured, int(n.sum()) * centres.k))
        if i < rounds:
            moved = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centres.at)
            centres = Centres(moved, centres.at)
            source = state.where("n is null").select("id", "v", "cluster", "upper", "lower")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.at.tolist()]
    total = sum(spread.tolist())
    rows = [(c, int(spread[c]), total, digests[c]) for c in range(centres.k)]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = state.where("n is null").select("id", "cluster", "distance")
    return assigned.join(F.broadcast(named), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").toDF(*names)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_centroid_clusters": op12_centroid_clusters}


def _sql(k: int = 40, dim: int = 64, rounds: int = 5, seed: int = 2) -> str:
    apart = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    nearest = f"SELECT r, vec_id, v, cluster, {apart} AS distance FROM x, c%d QUALIFY row_number() OVER (PARTITION BY r ORDER BY {apart}, cluster) = 1"
    steps = [
        f"""x AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim}
    )""",
        f"""c0 AS (
        SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1)::INTEGER AS cluster, v AS c FROM x WHERE vec_id IS NOT NULL
        QUALIFY cluster < {k}
    )""",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS ({nearest % i})",
            f"""m{i} AS (
        SELECT cluster, j, (s - ((s % n) + n) % n) // n AS e
        FROM (SELECT cluster, j, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS e, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY cluster, j)
    )""",
            f"c{i + 1} AS (SELECT cluster, coalesce(l, c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(e ORDER BY j) AS l FROM m{i} GROUP BY cluster) USING (cluster))",
        ]
    steps.append(f"a AS ({nearest % rounds})")
    return f"""
    WITH {", ".join(steps)}
    SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a JOIN c{rounds} USING (cluster)
    """


ORACLES = {"op12_centroid_clusters": _sql()}
