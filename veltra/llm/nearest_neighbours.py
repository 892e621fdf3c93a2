"""Approximate nearest neighbours by cosine: inverted lists, scanned by column blocks with early abandoning.

**Distinct vectors.** Equal vectors become one, with its k + 1 smallest ids: no more of them can be among the k nearest of
anything. So a vector with a third of all rows is indexed, and searched for, once.

**Index.** Unit vectors are turned by a random rotation, which makes any few of their components a fair sample of all, and
kept in blocks of BLOCK components next to the original. Lists belong to centroids fitted on a sample of SAMPLE distinct
vectors (the smallest digests; all vectors are indexed). Of the sample's own nearest neighbours, REACH must lie in the
probed lists: that gives the number of probes, which so follows from the data. Lists over PART vectors are cut into parts.

**Search.** A query's (k + 1)-th nearest in the sample bounds the distance that can matter; its seeds, those k + 1, are
searched for whatever the tests say, so that no query stays without neighbours. Queries go to the parts of their lists.
There distances to all vectors of a part grow block by block: after d of D components a vector is abandoned if its partial
squared distance, times D / d, is over the bound times (1 + EPSILON / sqrt(d)) ** 2, the test of the hypothesis that it is
within the bound. Those left get the exact cosine of the original vectors in double precision, summed in one order. The
best of all parts are merged, and dealt to the rows that asked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

#: Distinct vectors that centroids, probes and bounds are taken from.
SAMPLE = 16_384
#: Vectors of a list on average, and lists at most: centroids go to all tasks.
LIST_ROWS, MAX_LISTS = 500, 1024
#: Vectors of a list that one task holds.
PART = 16_384
#: Share of the sample's neighbours that the probed lists must hold.
REACH = 0.98
#: Components of a block, and how sure a test is: at 2.1 about one in a thousand near vectors is lost.
BLOCK, EPSILON = 8, 2.1
#: More than the rounding of 32-bit squared distances of unit vectors.
ROUNDING = 1e-5
#: Ways in which the rows that ask for one vector are split.
SALT = 16


def usable(vec: Column, dim: int) -> Column:
    finite = F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return (F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width).astype(np.float64)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and its lengths; a vector whose squares leave the range of doubles is divided by its largest component before."""
    with np.errstate(over="ignore", under="ignore"):
        length = np.sqrt(_summed(x * x))
    odd = ~np.isfinite(length) | (length < 1e-150)
    if odd.any():
        x = x.copy()
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
        length[odd] = np.sqrt(_summed(x[odd] ** 2))
    return x, length


def _summed(terms: np.ndarray) -> np.ndarray:
    """Row sums, component by component, so that they don't depend on what else is in the batch."""
    total = np.zeros(len(terms))
    for j in range(terms.shape[1]):
        total += terms[:, j]
    return total


def _keyed(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, id, vec) with a digest of the vector; -0.0 and 0.0 are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dim) + 0.0
            keys = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], ["row", "id", "vec", "key"])

    return run


class Lists:
    """Rotation, centroids and number of probes, from a sample of distinct vectors."""

    def __init__(self, keys: list[bytes], sample: np.ndarray, lists: int, k: int, reach: float = REACH, seed: int = 13):
        dim = sample.shape[1]
        draw = np.random.default_rng(seed)
        q, r = np.linalg.qr(draw.normal(size=(dim, dim)))
        self.turn = q * np.sign(np.diag(r))
        self.keys, self.k, self.dim = keys, k, dim
        self.sample = self.turned(sample)
        self.centres = self.sample[:lists].astype(np.float64)
        for _ in range(8):
            own = self.of(self.sample)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, self.sample)
            length = np.linalg.norm(sums, axis=1)
            self.centres[length > 0] = sums[length > 0] / length[length > 0, None]
        self.own = self.of(self.sample)
        self.probes = self._probes(reach)

    def turned(self, x: np.ndarray) -> np.ndarray:
        x, length = _scaled(x)
        return ((x / length[:, None]) @ self.turn).astype(np.float32)

    def of(self, turned: np.ndarray) -> np.ndarray:
        return np.concatenate([(turned[i : i + 4096] @ self.centres.T).argmax(axis=1) for i in range(0, len(turned), 4096)] or [np.zeros(0, int)])

    def _probes(self, reach: float) -> int:
        asked = np.arange(min(256, len(self.sample)))
        near = self.sample[asked] @ self.sample.T
        near[asked, asked] = -2
        best = np.argsort(-near, axis=1)[:, : min(self.k, len(self.sample) - 1)]
        place = np.argsort(np.argsort(-(self.sample[asked] @ self.centres.T), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(place, self.own[best], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(reach * len(needed))))]) + 1 if len(needed) else 1

    def asked(self, turned: np.ndarray) -> tuple[list[list[int]], np.ndarray, list[list[bytes]]]:
        """Of each query: the lists to probe, the bound of the squared distance, and its seeds."""
        probes, bounds, seeds = [], [], []
        for i in range(0, len(turned), 512):
            near = turned[i : i + 512] @ self.sample.T
            order = np.argsort(-(turned[i : i + 512] @ self.centres.T), axis=1)[:, : self.probes]
            n = min(self.k + 1, near.shape[1])
            best = np.argpartition(-near, n - 1, axis=1)[:, :n]
            worst = np.take_along_axis(near, best, axis=1).min(axis=1)
            bounds += (2 - 2 * worst if n == self.k + 1 else np.full(len(near), 4.0)).tolist()
            probes += [sorted({*a, *b}) for a, b in zip(order.tolist(), self.own[best].tolist(), strict=True)]
            seeds += [[self.keys[j] for j in row] for row in best.tolist()]
        return probes, np.array(bounds), seeds


def _blocks(turned: np.ndarray) -> list[pa.Array]:
    out = []
    for j in range(0, turned.shape[1], BLOCK):
        part = np.ascontiguousarray(turned[:, j : j + BLOCK])
        out.append(pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1], pa.array(part.ravel())))
    return out


def _indexed(lists: Lists) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, vec, members) -> (key, vec, members, list, blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = lists.turned(_matrix(batch.column(1), lists.dim))
            own = [pa.array(lists.of(turned).astype(np.int32)), *_blocks(turned)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], ["key", "vec", "members", "list", *(f"b{j}" for j in range(len(own) - 1))])

    return run


def _asking(lists: Lists) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, vec) -> (key, vec, probes, bound, seeds, blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = lists.turned(_matrix(batch.column(1), lists.dim))
            probes, bounds, seeds = lists.asked(turned)
            own = [pa.array(probes, pa.list_(pa.int32())), pa.array(bounds, pa.float64()), pa.array(seeds, pa.list_(pa.binary())), *_blocks(turned)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], ["key", "vec", "probes", "bound", "seeds", *(f"b{j}" for j in range(len(own) - 3))])

    return run


def scan(blocks: list[np.ndarray], query: list[np.ndarray], bound: float, epsilon: float = EPSILON) -> np.ndarray:
    """Places of the vectors whose squared distance to the query is within the bound, as far as the tests can tell."""
    dim = sum(b.shape[1] for b in blocks)
    left, far, seen = np.arange(len(blocks[0])), np.zeros(len(blocks[0]), np.float32), 0
    for own, q in zip(blocks, query, strict=True):
        gap = own[left] - q
        far += np.einsum("ij,ij->i", gap, gap)
        seen += own.shape[1]
        sure = 1.0 if seen == dim else (1 + epsilon / np.sqrt(seen)) ** 2
        near = far * (dim / seen) <= bound * sure + ROUNDING
        left, far = left[near], far[near]
        if not len(left):
            break
    return left


def _scanned(dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by list and part, vectors before queries -> the k + 1 nearest of a part for each query."""
    n_blocks = -(-dim // BLOCK)

    def turned(batch: pa.RecordBatch, lo: int, hi: int) -> list[np.ndarray]:
        parts = [batch.column(8 + j)[lo:hi].flatten() for j in range(n_blocks)]
        return [np.asarray(p).reshape(hi - lo, -1) for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, loaded, held = None, None, []
        for batch in batches:
            where = np.column_stack([np.asarray(batch.column(j)).astype(np.int64) for j in range(3)])  # list, part, asks
            edges = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            out: list[tuple] = []
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(where)], strict=True):
                if lo == hi:
                    continue
                if (at := tuple(where[lo, :2])) != now:
                    now, loaded, held = at, None, []
                x = _matrix(batch.column(4)[lo:hi], dim)
                keys = batch.column(3)[lo:hi].to_pylist()
                if not where[lo, 2]:
                    held.append((keys, x, batch.column(5)[lo:hi].to_pylist(), turned(batch, lo, hi)))
                    continue
                if loaded is None and held:
                    vectors, length = _scaled(np.concatenate([h[1] for h in held]))
                    blocks = [np.concatenate([h[3][j] for h in held]) for j in range(n_blocks)]
                    own = [key for h in held for key in h[0]]
                    loaded = vectors, length, [m for h in held for m in h[2]], blocks, {key: i for i, key in enumerate(own)}
                    held = []
                if loaded is None:
                    continue
                vectors, length, members, blocks, place = loaded
                x, own_length = _scaled(x)
                bounds, seeds = np.asarray(batch.column(6)[lo:hi]), batch.column(7)[lo:hi].to_pylist()
                q = turned(batch, lo, hi)
                for i, key in enumerate(keys):
                    left = scan(blocks, [b[i] for b in q], float(bounds[i]))
                    left = np.union1d(left, [place[s] for s in seeds[i] if s in place]).astype(np.int64)
                    if not len(left):
                        continue
                    score = _summed(vectors[left] * x[i]) / (length[left] * own_length[i])
                    if len(left) > k + 1:  # all that tie with the last stay
                        worst = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                        left, score = left[score >= worst], score[score >= worst]
                    out += [(key, float(s), members[j]) for j, s in zip(left.tolist(), score.tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            kinds = (pa.binary(), pa.float64(), batch.schema.field(5).type)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "score", "members"])

    return run


def commonest_length(vectors: DataFrame, vec_col: str) -> int:
    sizes = vectors.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count().where("d > 0")
    most = sizes.orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
    return most[0]["d"] if most else 0


def nearest(
    vectors: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None, sample: int = SAMPLE, list_rows: int = LIST_ROWS,
    part: int = PART, reach: float = REACH,
) -> DataFrame:
    """query_id, rank (from 1), id_col, score (cosine) for each row where asks, a condition on id_col, holds.

    All rows but the query's own are candidates, those that repeat its id or vector, or have no id, too; of equal scores
    the smaller id comes first, rows without an id last. Vectors that are null, zero or hold null or non-finite components
    take no part, nor do those of another length than dim (by default the commonest). A query with fewer candidates gets
    all of them, an empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    dim = commonest_length(vectors, vec_col) if dim is None else dim
    named = ("query_id", "rank", id_col, "score")
    kept = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(usable(F.col("vec"), dim))
    vec = f"array<{vectors.schema[vec_col].dataType.elementType.simpleString()}>"
    rows = written(kept.mapInArrow(_keyed(dim), f"row long, id long, vec {vec}, key binary"), "vectors")
    if not rows.limit(1).count():
        return rows.where(F.lit(False)).select("id", F.lit(0), F.col("id").alias("other"), F.lit(0.0)).toDF(*named)

    first = Window.partitionBy("key").orderBy(F.col("id").asc_nulls_last(), "row")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    member = F.struct("n", "id", "row")
    distinct = few.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list(member)).alias("members"))
    members = "array<struct<n:int,id:bigint,row:bigint>>"
    distinct = written(distinct.select("key", "vec", F.col("members").cast(members).alias("members")), "distinct")
    n = distinct.count()
    drawn = distinct.orderBy("key").limit(sample).select("key", "vec").toArrow()
    lists = max(1, min(MAX_LISTS, round(n / list_rows), drawn.num_rows // 8))
    model = Lists(drawn["key"].to_pylist(), _matrix(drawn["vec"].combine_chunks(), dim), lists, k, reach)

    blocks = [f"b{j}" for j in range(-(-dim // BLOCK))]
    kinds = ", ".join(f"{b} array<float>" for b in blocks)
    index = written(distinct.mapInArrow(_indexed(model), f"key binary, vec {vec}, members {members}, list int, {kinds}"), "lists")
    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))  # MAX_LISTS rows
    here = index.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), F.lit(0).alias("asks"), "key", "vec", "members", *blocks)
    asking = rows.where(asks).select("row", "id", "key")
    one = rows.where(asks).groupBy("key").agg(F.first("vec").alias("vec"))
    one = one.mapInArrow(_asking(model), f"key binary, vec {vec}, probes array<int>, bound double, seeds array<binary>, {kinds}")
    sent = one.withColumn("list", F.explode("probes")).join(F.broadcast(sizes), "list")
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("list", "part", F.lit(1).alias("asks"), "key", "vec", F.lit(None).cast(members).alias("members"), "bound", "seeds", *blocks)
    both = here.unionByName(sent, allowMissingColumns=True).select("list", "part", "asks", "key", "vec", "members", "bound", "seeds", *blocks)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(tasks, "list", "part").sortWithinPartitions("list", "part", "asks")
    found = dealt.mapInArrow(_scanned(dim, k), f"key binary, score double, members {members}").select("key", "score", F.inline("members"))
    best_first = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    ranked = found.withColumn("at", F.row_number().over(best_first)).where(F.col("at") <= k + 1)
    entry = F.struct("at", "id", "row", "score")
    best = ranked.groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("best"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    answered = asking.withColumn("salt", F.pmod("row", F.lit(SALT)).cast("int")).join(best, ["key", "salt"])
    others = F.slice(F.filter("best", lambda x: x["row"] != F.col("row")), 1, k)
    out = answered.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "other"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("other.id").alias(id_col), F.col("other.score").alias("score"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {"op13_nearest_neighbours": op13_nearest_neighbours}
ORACLES: dict[str, str] = {}
