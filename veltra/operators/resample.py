"""Resampling whose draws are arithmetic on numbers and iterations: the same on every engine, and after a lost executor.

Nothing is copied for an iteration. Scores become a matrix in blocks of samples and pathways; a task is told the labels or
the number of draws of all iterations for its block of samples and multiplies: weights of iterations by samples, times
samples by pathways, gives counts, sums and sums of squares for each group. Only these, a row for each iteration, group and
pathway of a task, are shuffled, and what the blocks are told: some bits a sample and iteration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weights import d
from ..session import broadcast_if_small, cut, numbered
from .inference import anova, cohens_d
from .order import smallest

PRIME = 2147483647
BROADCAST_ROWS = 1_000_000
#: Rounds of a permutation; each swaps half of all pairs of numbers with the same sum.
ROUNDS = 24
#: Samples and pathways of a block of the matrix, and parts that the samples of a block of pathways are dealt to.
SAMPLES, PATHWAYS, PARTS = 1024, 128, 96
#: Numbers that are mixed at a time, so that they stay in a cache, and draws of an iteration that are told in one go.
CELLS, DRAWS = 1 << 15, 1 << 24
#: Samples whose labels one task deals, a byte each, some iterations one after the other. Of more samples, or more groups
#: than a byte tells apart, a task works out where its own ones go, which takes several times as long.
DEALT, TURNS = 1 << 25, 4


def mixed(ident: Column, iteration: Column, seed: int = 42) -> Column:
    """A number under PRIME from an id and an iteration."""
    ident, iteration = F.pmod(ident.cast("long"), F.lit(PRIME)), iteration.cast("long")
    a = F.pmod(ident * F.lit(1103515245) + iteration * F.lit(40503) + F.lit(seed), F.lit(PRIME))
    return F.pmod(a * F.lit(48271) + F.pmod(a, F.lit(65537)) * (iteration + F.lit(1)), F.lit(PRIME))


def mixed_numbers(ident: np.ndarray, iteration: np.ndarray, seed: int = 42) -> np.ndarray:
    """mixed() on arrays of 64-bit integers."""
    a = (ident % PRIME * 1103515245 + iteration * 40503 + seed) % PRIME
    return (a * 48271 + a % 65537 * (iteration + 1)) % PRIME


def _folded(v: np.ndarray) -> np.ndarray:
    """v modulo PRIME, in place: unsigned numbers whose upper bits (beyond 31) and lower ones add up to less than 2 * PRIME.
    PRIME is 2 ** 31 - 1, so that no division is needed."""
    high = v >> 31
    v &= PRIME
    v += high
    return np.minimum(v, np.subtract(v, PRIME, out=high), out=v)  # what is below zero is very large


def _mixed_in_place(v: np.ndarray, add: np.ndarray, times: np.ndarray) -> np.ndarray:
    """mixed_numbers() of unsigned numbers under PRIME, in place; add and times are iteration * 40503 + seed, modulo PRIME,
    and iteration + 1."""
    v *= 1103515245
    v += add
    _folded(v)
    high, low = v >> 16, v & 65535
    low -= high  # 65536 is -1 modulo 65537
    np.minimum(low, np.add(low, 65537, out=high), out=low)
    low *= times
    v *= 48271
    v += low
    return _folded(v)


def _steps(count: int) -> np.ndarray:
    """What mixed_numbers() makes of consecutive numbers first: their products, modulo PRIME."""
    return (np.arange(count, dtype=np.uint64) * np.uint64(1103515245) % np.uint64(PRIME)).astype(np.uint32)


def _start(first: int, iteration: int, seed: int) -> int:
    return (first * 1103515245 + iteration * 40503 + seed) % PRIME


def _mixed_run(steps: np.ndarray, start: np.ndarray, times: np.ndarray) -> np.ndarray:
    """mixed_numbers() of first, first + 1, ... from _steps(), _start() of first and iteration + 1. Consecutive numbers need no
    product for the first half, and half the bits."""
    a = steps + start
    np.minimum(a, a - PRIME, out=a)  # what is below zero is very large
    high, low = a >> 16, a & 65535
    low -= high  # 65536 is -1 modulo 65537
    np.minimum(low, np.add(low, 65537, out=high), out=low)
    v, w = a.astype(np.uint64), low.astype(np.uint64)
    v *= 48271
    w *= times
    v += w
    np.right_shift(v, 31, out=w)
    v &= PRIME
    v += w
    out = v.astype(np.uint32)
    return np.minimum(out, out - PRIME, out=out)


def permuted_labels(labels: np.ndarray, iteration: int, seed: int = 42) -> np.ndarray:
    """labels[permuted_numbers(all, [iteration], n)[0]], labels being bytes. The rounds are gone through backwards, and each
    swaps labels in place: a pair of numbers is mixed once, and the larger ones of a round's pairs are consecutive."""
    m, n = labels.copy(), len(labels)
    turn = np.arange(ROUNDS)
    keys = (mixed_numbers(mixed_numbers(turn, np.int64(iteration), seed), turn, seed) % max(1, n)).tolist()
    steps = _steps(min(CELLS, n // 2 + 1))
    for r in reversed(range(ROUNDS)):
        number = iteration * 64 + r
        for lo, hi in ((0, keys[r]), (keys[r] + 1, n - 1)):
            half = (hi - lo + 1) // 2
            first = hi - half + 1
            upper, lower = m[first : hi + 1], m[lo : lo + half][::-1]
            for at in range(0, half, CELLS):
                u, v = upper[at : at + CELLS], lower[at : at + CELLS]
                bit = _mixed_run(steps[: len(u)], np.uint32(_start(first + at, number, seed)), np.uint64(number + 1))
                bit >>= 16
                bit &= 1
                swap = u ^ v
                swap *= bit.astype(np.uint8)
                u ^= swap
                v ^= swap
    return m


def permuted_numbers(i: np.ndarray, iterations: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """iterations by i: where each of the numbers 0 to n - 1 goes in each iteration. A round looks at the pair of numbers
    with the sum of its key (modulo n) and swaps them or not, by a bit of the larger one: one to one in every round, so
    that a task can do it for its own numbers alone. n is at most PRIME."""
    if n > PRIME:
        raise ValueError(f"{n} numbers are more than {PRIME}")
    its, turn = iterations.astype(np.int64)[:, None], np.arange(ROUNDS)
    keys, n = (mixed_numbers(mixed_numbers(turn, its, seed), turn, seed) % n).astype(np.uint64), np.uint64(n)
    rounds = its * 64 + turn
    adds, times = ((rounds * 40503 + seed) % PRIME).astype(np.uint64), (rounds + 1).astype(np.uint64)
    out = np.empty((len(its), len(i)), np.uint64)
    out[:] = i.astype(np.uint64)
    some = max(1, CELLS // max(1, len(i)))
    for at in range(0, len(its), some):
        x = out[at : at + some]
        for r in range(ROUNDS):
            key, add, time = (v[at : at + some, r : r + 1] for v in (keys, adds, times))
            other = key - x
            np.minimum(other, other + n, out=other)
            bit = _mixed_in_place(np.maximum(x, other), add, time)
            bit >>= 16
            bit &= 1
            other -= x
            other *= bit
            x += other
    return out.astype(np.int64)


def permuted(labels: DataFrame, n_permutations: int, seed: int = 42) -> DataFrame:
    """labels (sample_id, grp) -> (it, sample_id, grp): for each iteration the labels dealt anew in a mixed order.

    The order is one over all iterations, whose equal shares are numbered range by range: no task holds an iteration.
    """
    own = cut(numbered(labels.select("sample_id"), "sample_id"))
    n = max(1, own.count())
    its = labels.select("sample_id", "grp", F.explode(F.sequence(F.lit(1), F.lit(n_permutations))).alias("it"))
    dealt = numbered(its.withColumn("__mix", mixed(F.col("sample_id"), F.col("it"), seed)), "it", "__mix", "sample_id", name="j")
    dealt = dealt.select("it", (F.col("j") % n).alias("i"), "grp")
    return dealt.join(broadcast_if_small(own, BROADCAST_ROWS), "i").select("it", "sample_id", "grp")


_SUMS = pa.schema([("pblock", pa.int64()), ("it", pa.int32()), ("g", pa.int32()), *((c, pa.list_(pa.float64())) for c in ("n", "s", "ss"))])

class Rows(NamedTuple):
    """The samples of a block that have scores: their places in it, groups, and counts, scores and squares by pathway."""

    at: np.ndarray
    g: np.ndarray
    m: np.ndarray


#: (block of samples, its rows, what the block was told) -> for some iterations from one on, their sums for a group.
Weights = Callable[[int, Rows, list], Iterator[tuple[int, int, np.ndarray]]]


class Matrix(NamedTuple):
    """Scores less the mean of their pathway, in vectors of PATHWAYS: rows (pblock, i, g, places, xs), the numbers of the
    pathways (pathway, mu, p), how many there are, the names of the groups and how many samples each has."""

    rows: DataFrame
    axis: DataFrame
    n_pathways: int
    names: list
    sizes: np.ndarray


def _products(weights: Weights, n_groups: int, iterations: int, n_pathways: int, samples: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(pblock, part, sblock, i, g, places, xs, drawn) in that order -> sums of all that a task has of a block of pathways.
    A row is a sample's scores of a block of pathways, or what is told of a block of samples (i below zero)."""

    def width(pblock: int) -> int:
        return min(PATHWAYS, n_pathways - pblock * PATHWAYS)

    def add(sums: np.ndarray, sblock: int, parts: list[tuple], told: list) -> None:
        if not parts:
            return
        i, g, lengths, places, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        m = np.zeros((len(i), *sums.shape[2:]))
        at = np.repeat(np.arange(len(i)), lengths)
        m[at, 0, places], m[at, 1, places], m[at, 2, places] = 1.0, x, x * x
        told = [t for _, t in sorted(told, key=lambda t: t[0])]
        for own, first, part in weights(sblock, Rows(i - sblock * samples, g, m.reshape(len(i), -1)), told):
            sums[own, first : first + len(part)] += part.reshape(-1, *sums.shape[2:])

    def result(pblock: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for g in range(n_groups):
            columns = [np.full(iterations, pblock), np.arange(1, iterations + 1, dtype=np.int32), np.full(iterations, g, np.int32)]
            edges = np.arange(iterations + 1, dtype=np.int32) * sums.shape[3]
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(sums[g, :, k]).ravel())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *lists], schema=_SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sblock, parts, told, sums = None, None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            pblocks, sblocks, i, g = (batch.column(k).to_numpy() for k in (0, 2, 3, 4))
            edges = np.flatnonzero(np.diff(pblocks) | np.diff(sblocks)) + 1
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(i)], strict=True):
                p, s = int(pblocks[first]), int(sblocks[first])
                if (p, s) != (block, sblock):
                    if sums is not None:
                        add(sums, sblock, parts, told)
                    if p != block:
                        if sums is not None:
                            yield from result(block, sums)
                        sums = np.zeros((n_groups, iterations, 3, width(p)))
                    block, sblock, parts, told = p, s, [], []
                here = slice(first, last)
                head = i[here] < 0
                told += [(int(g[k]), batch.column(7)[k].as_py()) for k in (first + np.flatnonzero(head)).tolist()]
                if not head.all():
                    places, xs = (batch.column(k)[here] for k in (5, 6))  # null, of no values, where something is told
                    lengths = np.diff(places.offsets.to_numpy())[~head]
                    parts.append((i[here][~head], g[here][~head], lengths, places.flatten().to_numpy(), xs.flatten().to_numpy()))
        if sums is not None:
            add(sums, sblock, parts, told)
            yield from result(block, sums)

    return run


def matrix(scores: DataFrame, labels: DataFrame) -> Matrix:
    """The scores of the samples that have a label (sample_id, grp), made once for all that is resampled."""
    own, names, sizes = _numbered_labels(labels)
    axis = cut(numbered(scores.groupBy("pathway").agg(F.avg("score").alias("mu")), "pathway", name="p"))
    small, n_pathways = broadcast_if_small(axis, BROADCAST_ROWS), axis.count()
    rows = scores.where("score is not null").join(own, "sample_id").join(small, "pathway")
    entry = F.struct((F.col("p") % PATHWAYS).cast("int").alias("at"), (F.col("score").cast("double") - F.col("mu")).alias("x"))
    block = F.floor(F.col("p") / PATHWAYS).alias("pblock")
    vectors = rows.groupBy(block, "i", "g").agg(F.collect_list(entry).alias("v"))  # PATHWAYS entries at most
    return Matrix(cut(vectors.select("pblock", "i", "g", F.col("v.at").alias("places"), F.col("v.x").alias("xs"))), small, n_pathways, names, sizes)


def _resampled(of: Matrix, told: DataFrame | None, weights: Weights, iterations: int) -> DataFrame:
    """(it, pathway, grp, n, s, ss): counts, sums and sums of squares of the scores, less the mean of their pathway.

    told (sblock, g, drawn): what a block of samples gets besides, in order of g.
    """
    n_pathways, n = of.n_pathways, int(of.sizes.sum())
    sblock = F.floor(F.col("i") / SAMPLES)
    kind = "array<long>" if told is None else told.schema["drawn"].dataType
    vectors = of.rows.select("pblock", sblock.alias("sblock"), "i", "g", "places", "xs", F.lit(None).cast(kind).alias("drawn"))
    if told is not None:
        last = max(0, n_pathways - 1) // PATHWAYS
        head = told.withColumn("pblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))).select("pblock", "sblock", F.lit(-1).cast("long").alias("i"), "g", *[F.lit(None).cast(t).alias(c) for c, t in (("places", "array<int>"), ("xs", "array<double>"))], "drawn")
        vectors = vectors.unionByName(head)
    # A task has the blocks of samples of one part and one block of pathways: equal shares, one more or less.
    parts = max(1, min(PARTS, -(-n // SAMPLES)))
    vectors = vectors.withColumn("part", (F.col("sblock") % parts).cast("int")).select("pblock", "part", "sblock", "i", "g", "places", "xs", "drawn")
    tasks = max(1, -(-n_pathways // PATHWAYS)) * parts
    dealt = vectors.repartitionById(tasks, (F.col("pblock") * parts + F.col("part")).cast("int")).sortWithinPartitions("pblock", "part", "sblock")
    kinds = "pblock long, it int, g int, n array<double>, s array<double>, ss array<double>"
    parts = dealt.mapInArrow(_products(weights, len(of.names), iterations, n_pathways, SAMPLES), kinds).select("pblock", "it", "g", F.posexplode(F.arrays_zip("n", "s", "ss")).alias("at", "v"))
    sums = parts.groupBy((F.col("pblock") * PATHWAYS + F.col("at")).alias("p"), "it", "g").agg(*[F.sum(f"v.{c}").alias(c) for c in ("n", "s", "ss")])
    grp = F.get(F.array(*map(F.lit, of.names)), F.col("g"))
    return sums.where("n > 0").join(of.axis, "p").select("it", "pathway", grp.alias("grp"), "n", "s", "ss")


def _numbered_labels(labels: DataFrame) -> tuple[DataFrame, list, np.ndarray]:
    """(sample_id, i, g), the names of the groups in order (they are few), and how many samples each has."""
    labels = cut(labels.select("sample_id", "grp"))
    sizes = labels.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).orderBy("grp").collect()
    names = [r["grp"] for r in sizes]
    known = numbered(labels.where("grp is not null").select("sample_id", "grp"), "sample_id")
    return cut(known.select("sample_id", "i", (F.array_position(F.array(*map(F.lit, names)), F.col("grp")) - 1).cast("int").alias("g")) if names else known.select("sample_id", "i", F.lit(0).alias("g"))), names, np.array([r["n"] for r in sizes])


def _dealt(spark: SparkSession, sizes: np.ndarray, n_permutations: int, seed: int) -> DataFrame:
    """(sblock, g, drawn): the labels that each block of samples gets in the iterations from number g on, TURNS at most, in
    bits. A row of the table is these iterations, whose labels, in order of their group, a task deals anew."""
    n, bits = int(sizes.sum()), _bits(len(sizes))
    blocks, each = -(-n // SAMPLES), SAMPLES * bits // 8

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.repeat(np.arange(len(sizes), dtype=np.uint8), sizes)
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                its = range(unit * TURNS + 1, min(n_permutations, (unit + 1) * TURNS) + 1)
                packed = np.zeros((blocks, len(its), each), np.uint8)
                for k, it in enumerate(its):
                    dealt = np.zeros(blocks * SAMPLES, np.uint8)
                    dealt[:n] = permuted_labels(labels, it, seed)
                    dealt = dealt.reshape(blocks, each, 8 // bits)
                    for j in range(8 // bits):
                        packed[:, k] |= dealt[:, :, j] << (j * bits)
                edges = pa.array(np.arange(blocks + 1, dtype=np.int32) * (len(its) * each))
                drawn = pa.Array.from_buffers(pa.binary(), blocks, [None, edges.buffers()[1], pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks)), pa.array(np.full(blocks, its[0], np.int32)), drawn], ["sblock", "g", "drawn"])

    units = -(-n_permutations // TURNS) if n else 0
    tasks = max(1, min(units, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, units, 1, tasks).mapInArrow(told, "sblock long, g int, drawn binary")


def _bits(n_groups: int) -> int:
    return next(b for b in (1, 2, 4, 8) if n_groups <= 1 << b)


def permuted_sums(scores: DataFrame | None, labels: DataFrame | None, n_permutations: int, seed: int = 42, of: Matrix | None = None) -> DataFrame:
    """(it, pathway, grp, n, s, ss) with the labels dealt anew in each iteration: the sample with number i gets the label
    of the place where i goes, among labels in order of their group. of: matrix() of scores and labels."""
    of = of or matrix(scores, labels)
    sizes = of.sizes
    upto, n, samples, some = np.cumsum(sizes), int(sizes.sum()), SAMPLES, max(1, 4 * CELLS // SAMPLES)

    def worked_out(sblock: int, rows: Rows, told: list) -> Iterator[tuple[int, int, np.ndarray]]:
        for first in range(0, n_permutations, some):
            its = np.arange(first + 1, min(n_permutations, first + some) + 1)
            dealt = np.searchsorted(upto, permuted_numbers(rows.at + sblock * samples, its, n, seed), "right")
            for own in range(len(upto)):
                yield own, first, (dealt == own).astype(np.float64) @ rows.m

    if n > DEALT or len(sizes) > 256:
        return _resampled(of, None, worked_out, n_permutations)
    bits = _bits(len(sizes))

    def weights(sblock: int, rows: Rows, told: list) -> Iterator[tuple[int, int, np.ndarray]]:
        packed = np.frombuffer(b"".join(told), np.uint8).reshape(n_permutations, -1)
        label = np.arange(256)[:, None] >> np.arange(0, 8, bits) & ((1 << bits) - 1)  # of the samples that a byte is for
        m = np.zeros((samples, rows.m.shape[1]))
        m[rows.at] = rows.m
        for own in range(len(sizes)):
            there = (label == own).astype(np.float64)
            for first in range(0, n_permutations, some):
                yield own, first, there[packed[first : first + some]].reshape(-1, samples) @ m

    return _resampled(of, _dealt(of.rows.sparkSession, sizes, n_permutations, seed), weights, n_permutations)


def _hits(spark: SparkSession, n: int, n_bootstrap: int, seed: int) -> DataFrame:
    """(sblock, it, c): how many of the n draws of each iteration fall on each block of samples, 0 included. A row of the
    table is DRAWS draws of an iteration, that a task works out from their numbers, some at a time."""
    blocks, slices = -(-n // SAMPLES), max(1, -(-n // DRAWS))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = _steps(min(CELLS, n))
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                it, first = unit // slices + 1, unit % slices * DRAWS
                counts = np.zeros(blocks, np.int64)
                last = min(n, first + DRAWS)
                for at in range(first, last, CELLS):
                    drawn = _mixed_run(steps[: last - at], np.uint32(_start(at, it, seed)), np.uint64(it + 1))
                    drawn -= drawn // n * n
                    drawn >>= SAMPLES.bit_length() - 1
                    counts += np.bincount(drawn, minlength=blocks)
                yield pa.RecordBatch.from_arrays([pa.array([it], pa.int32()), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["it", "c"])

    units = n_bootstrap * slices if n else 0
    tasks = max(1, min(units, 4 * spark.sparkContext.defaultParallelism))
    each = spark.range(0, units, 1, tasks).mapInArrow(told, "it int, c array<long>").select("it", F.posexplode("c").alias("sblock", "c"))
    each = each.withColumn("sblock", F.col("sblock").cast("long"))
    return each if slices == 1 else each.groupBy("sblock", "it").agg(F.sum("c").alias("c"))


def bootstrap_sums(scores: DataFrame | None, labels: DataFrame | None, n_bootstrap: int, seed: int = 42, of: Matrix | None = None) -> DataFrame:
    """(it, pathway, grp, n, s, ss) of as many samples as there are, drawn with replacement in each iteration. of: matrix()
    of scores and labels.

    First only the block of SAMPLES samples of each draw is told, and counted; which sample of its block a draw takes, the
    task of the block works out.
    """
    of = of or matrix(scores, labels)
    n, n_groups, samples, some = int(of.sizes.sum()), len(of.sizes), SAMPLES, max(1, CELLS // SAMPLES)
    told = _hits(of.rows.sparkSession, n, n_bootstrap, seed).groupBy("sblock").agg(F.sort_array(F.collect_list(F.struct("it", "c"))).alias("h"))  # an entry an iteration
    told = told.select("sblock", F.lit(-1).alias("g"), F.col("h.c").alias("drawn"))

    def weights(sblock: int, rows: Rows, told: list) -> Iterator[tuple[int, int, np.ndarray]]:
        size = min(samples, n - sblock * samples)
        times = np.array(told[0] if told else [0] * n_bootstrap)
        steps = _steps(int(times.max()))
        # Rows in order of their group; what is not among them goes into one more.
        order = np.argsort(rows.g, kind="stable")
        m, edges = rows.m[order], np.searchsorted(rows.g[order], np.arange(n_groups + 1))
        row = np.full(size + 1, len(order))
        row[rows.at[order]] = np.arange(len(order))
        for first in range(0, n_bootstrap, some):
            own = times[first : first + some, None]
            its = range(first + 1, first + len(own) + 1)
            starts = np.array([[_start(sblock * samples, it, seed + 1)] for it in its], np.uint32)
            taken = _mixed_run(steps[: own.max()], starts, np.array([[it + 1] for it in its], np.uint64))
            taken -= taken // size * size
            taken[np.arange(taken.shape[1]) >= own] = size
            cells = row[taken] + np.arange(len(own))[:, None] * (len(order) + 1)
            counts = np.bincount(cells.ravel(), minlength=len(own) * (len(order) + 1)).reshape(len(own), -1).astype(np.float64)
            for g in range(n_groups):
                yield g, first, counts[:, edges[g] : edges[g + 1]] @ m[edges[g] : edges[g + 1]]

    return _resampled(of, told, weights, n_bootstrap)


def _f_statistic(sums: DataFrame) -> DataFrame:
    """(it, pathway, f): as anova, from sums about any centre; null without spread or with too few groups or samples."""
    inside = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    parts = sums.groupBy("it", "pathway").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.greatest(inside, d(0))).alias("ssw"), between.alias("ssb"))
    usable = (F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("ssw") > 0)
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k")))
    return parts.select("it", "pathway", F.when(usable, f).otherwise(d(0)).alias("f"))


def permutation_p(scores: DataFrame, labels: DataFrame, n_permutations: int = 1000, seed: int = 42) -> DataFrame:
    """pathway, f_stat, p = (1 + permutations with at least that F) / (1 + permutations); what differs by less than a part
    in a thousand million counts as equal."""
    scores = cut(scores)
    return permutation_p_of(anova(scores.join(labels, "sample_id")), matrix(scores, labels), n_permutations, seed)


def permutation_p_of(tests: DataFrame, of: Matrix, n_permutations: int, seed: int) -> DataFrame:
    """permutation_p from the F statistics (pathway, f_stat) and the matrix of the scores."""
    seen = cut(tests.select("pathway", "f_stat"))
    null = _f_statistic(permuted_sums(None, None, n_permutations, seed, of))
    as_large = F.count_if(F.col("f") >= F.col("f_stat") - F.abs("f_stat") * 1e-9)
    hits = null.join(broadcast_if_small(seen, BROADCAST_ROWS), "pathway").groupBy("pathway").agg(as_large.alias("hits"))
    return seen.join(hits, "pathway").select("pathway", "f_stat", ((F.col("hits") + 1) / d(n_permutations + 1)).alias("p"))


def bootstrap_ci(labelled: DataFrame, n_bootstrap: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """pathway, lo, hi: percentiles of the largest absolute d over resamples with replacement. Groups under two draws have
    no d. labelled (sample_id, grp, pathway, score); a sample has one group."""
    labelled = cut(labelled)
    labels = labelled.select("sample_id", "grp").distinct()
    return bootstrap_ci_of(matrix(labelled.select("sample_id", "pathway", "score"), labels), n_bootstrap, level, seed)


def bootstrap_ci_of(of: Matrix, n_bootstrap: int, level: float = 0.95, seed: int = 42) -> DataFrame:
    """bootstrap_ci from the matrix of the scores."""
    sums = bootstrap_sums(None, None, n_bootstrap, seed, of)
    spread = F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), d(0)) / F.nullif(F.col("n") - 1, d(0))
    one = F.struct("grp", "n", (F.col("s") / F.col("n")).alias("mean"), spread.alias("var"))
    groups = sums.groupBy("it", "pathway").agg(F.sort_array(F.collect_list(one)).alias("a"))  # an entry a group
    pairs = groups.select("it", "pathway", F.posexplode("a").alias("i", "x"), "a").select("it", "pathway", "x", F.explode(F.slice("a", F.col("i") + 2, F.size("a"))).alias("y"))
    size = F.abs(cohens_d(*[F.col(f"{t}.{c}") for t in "xy" for c in ("n", "mean", "var")]))
    sizes = pairs.groupBy("it", "pathway").agg(F.max(size).alias("effect_size"))
    tail = (1 - level) / 2
    q = F.percentile("effect_size", F.array(d(tail), d(1 - tail)))  # a value an iteration
    return sizes.groupBy("pathway").agg(q.alias("q")).select("pathway", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def stratified_downsample(phenotypes: DataFrame, target: int, stratum: str, seed: int = 42) -> DataFrame:
    """target samples: target // strata of each stratum in a mixed order, then others in that order. No stratum is sorted:
    what its last sample is, is selected by counts. Rows without a stratum are dealt with as one more."""
    named = F.to_json(F.struct(F.col(stratum).alias("s")))
    rows = phenotypes.select("sample_id", stratum, named.alias("__stratum"), mixed(F.col("sample_id"), F.lit(0), seed).alias("__mix"), F.lit(0).alias("__all"))
    rows = cut(rows)
    strata = rows.agg(F.count_distinct(stratum)).first()[0]
    first = cut(smallest(rows, ["__stratum"], "__mix", target // max(1, strata), "sample_id"))
    more = target - first.count()
    if more <= 0:
        return smallest(first, ["__all"], "__mix", target, "sample_id").select("sample_id", stratum)
    # Behind the last of its stratum, in the order of smallest(): equal ones of both are neither before nor after it.
    last = cut(first.groupBy("__stratum").agg(F.max(F.struct("__mix", "sample_id")).alias("__last")))
    others = rows.join(broadcast_if_small(last, BROADCAST_ROWS), "__stratum", "left")
    others = others.where(F.col("__last").isNull() | (F.struct("__mix", "sample_id") > F.col("__last"))).drop("__last")
    return first.unionByName(smallest(others, ["__all"], "__mix", more, "sample_id")).select("sample_id", stratum)


def folds(samples: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """sample_id, fold from 0: equal shares in a mixed order, the first folds one larger."""
    mixed_order = samples.select("sample_id", mixed(F.col("sample_id"), F.lit(0), seed).alias("__mix"))
    ordered = cut(numbered(mixed_order, "__mix", "sample_id"))
    size, larger = divmod(ordered.count(), k)
    edge = larger * (size + 1)
    late = larger + F.floor((F.col("i") - edge) / max(1, size))
    fold = F.when(F.col("i") < edge, F.floor(F.col("i") / (size + 1))).otherwise(late)
    return ordered.select("sample_id", fold.cast("int").alias("fold"))
