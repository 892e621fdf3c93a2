"""Clustering of long scores, and what is done with many clusterings: gates, calibration, sensitivity, comparison.

Samples with equal scores are one row that counts for all of them, told apart on the cluster. A matrix of at most
MAX_CELLS cells of such rows is fitted in NumPy with the settings that the methods define (starts, regularisation). Many
fits are rows of a table of runs, spread over the cluster, each task with the matrix by a broadcast of that checked size.
Beyond it (an assignment: beyond MAX_FIT) ``assign_large`` fits on the whole table by passes that give sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import adjusted_rand, adjusted_rand_of
from ..session import broadcast_if_small, cut
from . import mlkit as K

MAX_CELLS = 20_000_000
#: Cells that the driver fits a mixture of by itself.
MAX_FIT = 2_000_000
#: Columns that are each an aggregate of its own; more are collected as a list.
WIDE = 200


class TooLarge(ValueError):
    pass


def names_of(scores: DataFrame, column: str = "pathway") -> list[str]:
    return sorted(r[0] for r in scores.select(column).distinct().collect())


def wide(scores: DataFrame, names: list[str], row: str = "sample_id", column: str = "pathway", value: str = "score") -> DataFrame:
    """(sample_id, x): values in the order of names; absent cells are 0."""
    rows = scores.select(F.col(row).alias("sample_id"), F.col(column).alias("__c"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("__v"))
    # Dealt by sample first: a small file is one task, which would hold a buffer for each of its samples.
    rows = rows.repartition(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sample_id")
    if len(names) <= WIDE:
        one = [F.max(F.when(F.col("__c") == n, F.col("__v"))).alias(f"__{i}") for i, n in enumerate(names)]
        return rows.groupBy("sample_id").agg(*one).select("sample_id", F.array(*[F.coalesce(F.col(f"__{i}"), F.lit(0.0)) for i in range(len(names))]).alias("x"))
    places = scores.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "__c string, __j int")
    lists = rows.join(F.broadcast(places), "__c").groupBy("sample_id").agg(F.collect_list("__j").alias("j"), F.collect_list(F.coalesce("__v", F.lit(0.0))).alias("v"))
    width, key = len(names), scores.schema[row].dataType.simpleString()

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, width))
            size = np.asarray(batch.column(1).value_lengths())
            x[np.repeat(np.arange(len(size)), size), np.asarray(batch.column(1).flatten())] = np.asarray(batch.column(2).flatten())
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, width, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["sample_id", "x"])

    return lists.mapInArrow(filled, f"sample_id {key}, x array<double>")


@dataclass
class Points:
    """Samples as points: table (sample_id, x, and what else they were told apart by); x the different rows of values, w
    how many samples each stands for, more what else each has."""

    table: DataFrame
    names: list[str]
    x: np.ndarray
    w: np.ndarray
    more: dict[str, np.ndarray]

    @property
    def n(self) -> int:
        return int(self.w.sum())

    def labels(self, found: dict[str, np.ndarray]) -> DataFrame:
        """name, sample_id, cluster: the labels of each sample's row."""
        rows = pa.table({"x": list(self.x), **{f"l{i}": np.asarray(y, np.int32) for i, y in enumerate(found.values())}})
        spark = self.table.sparkSession
        named = F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.col(f"l{i}").alias("cluster")) for i, a in enumerate(found)]))
        joined = self.table.join(broadcast_if_small(spark.createDataFrame(rows), 100_000), "x")
        return joined.select("sample_id", named.alias("f")).select("f.name", "sample_id", "f.cluster")


def points(scores: DataFrame, max_cells: int | None = None, names: list[str] | None = None, **more: DataFrame) -> Points:
    """Points of scores. more: {name: (sample_id, name)} by which samples are told apart, too; those without are left out.
    Raises TooLarge if the different rows have more than MAX_CELLS cells."""
    names = names_of(scores) if names is None else names
    table = wide(scores, names)
    for name, df in more.items():
        table = table.join(df.select("sample_id", name), "sample_id")
    table = cut(table)
    rows = cut(table.groupBy("x", *more).agg(F.count(F.lit(1)).alias("__w")))
    size, width = rows.count(), len(names)
    sample = rows.first()
    cells = size * (width + sum(len(sample[m]) for m in more if sample and isinstance(sample[m], list)))
    if cells > (MAX_CELLS if max_cells is None else min(max_cells, MAX_CELLS)):
        raise TooLarge(f"{size} different rows, {cells} cells; use assign_large")
    found = rows.toArrow().combine_chunks()
    get = lambda c: np.asarray(c.combine_chunks().flatten() if hasattr(c, "combine_chunks") else c.flatten(), float).reshape(size, -1)
    x = get(found["x"])
    kept = {m: get(found[m]) if isinstance(sample[m], list) else np.asarray(found[m].to_pylist()) for m in more} if size else {}
    keys = [np.asarray(v).T if np.ndim(v) == 2 else [v] for v in reversed(list(kept.values()))]
    order = np.lexsort([k for many in keys for k in reversed(list(many))] + [x[:, j] for j in reversed(range(width))])
    return Points(table, names, x[order], np.asarray(found["__w"], float)[order], {m: v[order] for m, v in kept.items()})


def dealt(rng: np.random.Generator, w: np.ndarray, sizes: Iterable[int]) -> np.ndarray:
    """How many of each row's samples fall into parts of these sizes, if all samples are dealt at random: rows by parts."""
    left, out = w.astype(np.int64), []
    for size in sizes:
        out.append(rng.multivariate_hypergeometric(left, int(size), method="marginals"))
        left = left - out[-1]
    return np.array(out).T


def run_all(spark: SparkSession, data: object, runs: Iterable[tuple], schema: str, fit: Callable[[object, tuple], tuple | list[tuple]], out: str) -> DataFrame:
    """fit(data, run) for each run, one task for each few runs. data is broadcast; matrix() has checked its size."""
    runs = list(runs)
    shared = spark.sparkContext.broadcast(data)
    table = spark.createDataFrame(runs, schema).repartition(max(1, min(len(runs), 4 * spark.sparkContext.defaultParallelism)))

    def each(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for run in batch.itertuples(index=False, name=None):
                found = fit(shared.value, run)
                rows += found if isinstance(found, list) else [found]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return table.mapInPandas(each, out)


def assign(scores: DataFrame, k: int | None = None, k_range: Iterable[int] = range(2, 9), seed: int = 42) -> DataFrame:
    """sample_id, cluster, confidence: a Gaussian mixture; without k the least BIC of the mixtures that converge. If more
    than MAX_FIT cells differ, assign_large."""
    spark, names = scores.sparkSession, names_of(scores)
    try:
        p = points(scores, MAX_FIT, names)
    except TooLarge:
        return assign_large(scores, names, k, seed=seed, k_range=k_range)
    if k is None:
        ks = [j for j in k_range if j < p.n]
        table = run_all(spark, (p.x, p.w), [(j,) for j in ks], "k int", lambda d, r: (r[0], *_bic(*d, r[0], seed)), "k int, bic double, converged boolean")
        found = sorted((r["bic"], r["k"]) for r in table.collect() if r["converged"]) or [(0.0, ks[0])]
        k = found[0][1]
    return _predicted(p.table, K.gmm(p.x, k, seed, w=p.w))


def _bic(x: np.ndarray, w: np.ndarray, k: int, seed: int) -> tuple[float, bool]:
    m = K.gmm(x, k, seed, w=w)
    return m.bic(w.sum()), m.converged


def _predicted(points: DataFrame, model: K.Mixture) -> DataFrame:
    """sample_id, cluster, confidence of points (sample_id, x) in a mixture."""
    key, width = points.schema["sample_id"].dataType.simpleString(), model.means.shape[1]

    def label(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            labels, confidence = model.predict(_values(batch, 1, width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.int32()), pa.array(confidence)], ["sample_id", "cluster", "confidence"])

    return points.select("sample_id", "x").mapInArrow(label, f"sample_id {key}, cluster int, confidence double")


def assign_large(
    scores: DataFrame, pathways: list[str], k: int | None, algorithm: str = "gmm", seed: int = 42, k_range: Iterable[int] = range(2, 9)
) -> DataFrame:
    """sample_id, cluster (and confidence) over a table of any size; only sums over it reach the driver. Without k the
    mixture with the least BIC."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = cut(wide(scores, pathways))
    if algorithm == "kmeans":
        features = points.select("sample_id", array_to_vector("x").alias("features"))
        out = KMeans(k=k, seed=seed, maxIter=300).fit(features).transform(features)
        return out.select("sample_id", F.col("prediction").alias("cluster"))
    n = points.count()
    fits = mixtures_large(points, n, [k] if k else [j for j in k_range if j < n], seed)
    return _predicted(points, min([m for m in fits if m.converged] or fits, key=lambda m: m.bic(n)))


def _values(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), float).reshape(-1, width)


def mixtures_large(points: DataFrame, n: int, ks: list[int], seed: int = 42, reg: float = 1e-6, max_iter: int = 100, tol: float = 1e-3) -> list[K.Mixture]:
    """A mixture of points (sample_id, x) for each number of clusters: expectation and maximisation, starting from k-means. A
    step is one pass for all fits that go on, whose sums of weights, values and products are taken up on the cluster: for a
    fit k * (1 + d + d * d) numbers come back."""
    fits: list[np.ndarray | K.Mixture] = list(_centres(points, ks, seed))
    d, shift = fits[0].shape[1], fits[0].mean(0)  # products about a point among the data lose no digits
    last, going = [-np.inf] * len(ks), list(range(len(ks)))

    def step(going: list[int]) -> dict[int, np.ndarray]:
        edges = np.cumsum([1 + ks[i] * (1 + d + d * d) for i in going])

        def sums(batches: Iterator[pa.RecordBatch]):
            total = np.zeros(edges[-1])
            for batch in batches:
                x = _values(batch, 0, d)
                total += np.concatenate([_sums(x, fits[i], ks[i], shift) for i in going])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["v"])

        found = points.select("x").mapInArrow(sums, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        every = np.array([r["v"] for r in sorted(found.collect(), key=lambda r: r["i"])])
        return dict(zip(going, np.split(every, edges[:-1]), strict=True))

    total = step(going)
    for _ in range(max_iter):
        for i in going:
            fits[i] = _maximised(total[i], ks[i], d, n, shift, reg)
        total = step(going)
        for i in going:
            fits[i].loglik = float(total[i][0])
            fits[i].converged = bool(abs(fits[i].loglik - last[i]) / n < tol)
            last[i] = fits[i].loglik
        going = [i for i in going if not fits[i].converged]
        if not going:
            break
    return fits


def _centres(points: DataFrame, ks: list[int], seed: int) -> list[np.ndarray]:
    """Centres of k-means for each number of clusters, at most eight fits side by side: a step of one leaves a cluster idle,
    and each holds the points."""
    from pyspark import inheritable_thread_target
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = points.select(array_to_vector("x").alias("features"))
    fit = inheritable_thread_target(points.sparkSession)(lambda k: np.array(KMeans(k=k, seed=seed, maxIter=300).fit(features).clusterCenters()))
    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(fit, ks))


def _sums(x: np.ndarray, fit: np.ndarray | K.Mixture, k: int, shift: np.ndarray) -> np.ndarray:
    """Log-likelihood of x in a fit (of centres: none), then weights, values and products of its clusters."""
    if isinstance(fit, np.ndarray):
        r, loglik = np.eye(k)[K.squared_distances(x, fit).argmin(1)], 0.0
    else:
        joint = fit.log_joint(x)
        top = joint.max(1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(joint - top).sum(1))
        r, loglik = np.exp(joint - norm[:, None]), norm.sum()
    y = x - shift
    products = [(r[:, j, None] * y).T @ y for j in range(k)]
    return np.concatenate([[loglik], r.sum(0), (r.T @ y).ravel(), np.ravel(products)])


def _maximised(total: np.ndarray, k: int, d: int, n: int, shift: np.ndarray, reg: float) -> K.Mixture:
    nk = total[1 : 1 + k] + 10 * np.finfo(float).eps
    means = total[1 + k : 1 + k + k * d].reshape(k, d) / nk[:, None]
    products = total[1 + k + k * d :].reshape(k, d, d) / nk[:, None, None]
    chols = np.linalg.cholesky(products - means[:, :, None] * means[:, None, :] + reg * np.eye(d))
    return K.Mixture(nk / n, means + shift, chols, -np.inf, False)


def select_k(scores: DataFrame, ks: Iterable[int] = range(2, 9), method: str = "bic", seed: int = 42) -> DataFrame:
    """k, bic, silhouette, chosen: the least BIC or the largest silhouette, converged or not."""
    p = points(scores)

    def fit(d, r):
        x, w = d
        labels, bic, _ = K.cluster(x, r[0], "gmm", seed, w=w)
        return r[0], bic, K.quality(x, labels, w)[0]

    table = cut(run_all(scores.sparkSession, (p.x, p.w), [(j,) for j in ks if j < p.n], "k int", fit, "k int, bic double, silhouette double"))
    key = F.col("bic") if method == "bic" else -F.col("silhouette")
    best = table.agg(F.min_by("k", key).alias("__k"))
    return table.join(F.broadcast(best)).select("k", "bic", "silhouette", (F.col("k") == F.col("__k")).alias("chosen"))


def labels_by_algorithm(scores: DataFrame, k: int, seed: int = 42, algorithms: Iterable[str] = K.ALGORITHMS) -> DataFrame:
    """algorithm, sample_id, cluster: each algorithm fitted once."""
    p = points(scores)
    return p.labels(_labels_by_algorithm(p, k, seed, algorithms)).withColumnRenamed("name", "algorithm")


def _labels_by_algorithm(p: Points, k: int, seed: int, algorithms: Iterable[str]) -> dict[str, np.ndarray]:
    names = list(algorithms)
    fit = lambda d, r: (r[0], K.cluster(d[0], k, r[0], seed, w=d[1])[0].tolist())
    fits = run_all(p.table.sparkSession, (p.x, p.w), [(a,) for a in names], "a string", fit, "algorithm string, labels array<int>")
    found = {r["algorithm"]: np.array(r["labels"]) for r in fits.collect()}  # a label vector of a matrix under MAX_CELLS each
    return {a: found[a] for a in names}


def compare_algorithms(scores: DataFrame, k: int, seed: int = 42, algorithms: Iterable[str] = K.ALGORITHMS) -> DataFrame:
    """algorithm, other, ari for each pair, and quality of the first. Each algorithm is fitted once."""
    p, spark = points(scores), scores.sparkSession
    fitted = _labels_by_algorithm(p, k, seed, algorithms)
    names = list(fitted)
    figures = run_all(spark, (p.x, p.w, fitted), [(a,) for a in names[:-1]], "a string", lambda d, r: (r[0], *K.quality(d[0], d[2][r[0]], d[1])), "algorithm string, s double, ch double, db double")
    quality = {r["algorithm"]: (r["s"], r["ch"], r["db"]) for r in figures.collect()}
    rows = [(a, b, adjusted_rand(fitted[a], fitted[b], p.w), *quality[a]) for i, a in enumerate(names) for b in names[i + 1 :]]
    out = "algorithm string, other string, ari double, silhouette double, calinski_harabasz double, davies_bouldin double"
    return spark.createDataFrame(rows, out)


def combined(cohorts: dict[str, DataFrame]) -> DataFrame:
    """cohort, sample_id, pathway, score of {name: scores}: one below the other, with the pathways that all have."""
    every = reduce(DataFrame.unionByName, [s.select(F.lit(name).alias("cohort"), "sample_id", "pathway", "score") for name, s in cohorts.items()])
    common = every.groupBy("pathway").agg(F.count_distinct("cohort").alias("n")).where(F.col("n") == len(cohorts)).select("pathway")
    return every.join(broadcast_if_small(common, 100_000), "pathway", "left_semi")


def cross_validate(scores: DataFrame, k: int, algorithm: str = "gmm", n_folds: int = 5, seed: int = 42) -> DataFrame:
    """fold, ari: a mixture fitted without the fold, on the fold, against the fit of all."""
    p = points(scores)
    whole = K.cluster(p.x, k, algorithm, seed, w=p.w)[0]
    folds = dealt(np.random.default_rng(seed), p.w, [len(range(f, p.n, n_folds)) for f in range(n_folds)])

    def fit(d, r):
        x, w, whole, folds = d
        test = folds[:, r[0]].astype(float)
        train, held = w - test > 0, test > 0
        if algorithm == "gmm":
            found = K.gmm(x[train], k, seed, w=(w - test)[train]).predict(x[held])[0]
        else:
            found = K.cluster(x, k, algorithm, seed + 1 + r[0], w=w)[0][held]
        return r[0], adjusted_rand(found, whole[held], test[held])

    return run_all(scores.sparkSession, (p.x, p.w, whole, folds), [(f,) for f in range(n_folds)], "f int", fit, "fold int, ari double")


def gates(
    scores: DataFrame,
    labels: DataFrame,
    burden: DataFrame,
    membership: DataFrame,
    k: int,
    n_permutations: int = 100,
    n_bootstrap: int = 50,
    null_ari_max: float = 0.15,
    stability_min: float = 0.8,
    seed: int = 42,
    pcs: DataFrame | None = None,
) -> DataFrame:
    """name, metric, threshold, passed of the label shuffle, the random gene sets and the bootstrap, and with pcs of
    the independence of ancestry. A gate none of whose fits converge has its failing value."""
    spark = scores.sparkSession
    genes = names_of(burden, "gene")
    samples = labels.select("sample_id", "cluster")
    own = wide(burden, genes, "sample_id", "gene", "burden").withColumnRenamed("x", "burdens")
    burdens = samples.select("sample_id").join(own, "sample_id", "left").withColumn("burdens", F.coalesce("burdens", F.array_repeat(F.lit(0.0), len(genes))))
    p = points(scores, burdens=burdens, cluster=samples)
    sets: dict[str, int] = {}
    for r in membership.groupBy("pathway").count().collect():
        sets[r["pathway"]] = min(r["count"], len(genes))
    sizes = [sets[p] for p in sorted(sets)]

    def fit(d, run):
        x, w, y, b = d
        gate, i = run
        rng = np.random.default_rng((seed, i, len(gate)))
        if gate == "label_shuffle":
            m = K.gmm(x, k, seed + i, 5, w=w)
            sums = lambda of: np.bincount(np.unique(of, return_inverse=True)[1], w)
            return gate, i, adjusted_rand_of(dealt(rng, sums(y), sums(m.predict(x)[0]))), m.converged
        if gate == "random_gene_sets":
            z = np.column_stack([b[:, rng.choice(b.shape[1], s, replace=False)].mean(1) for s in sizes])
            z = z - w @ z / w.sum()
            sd = np.sqrt(w @ (z * z) / (w.sum() - 1))
            z = np.nan_to_num(z / np.where(sd > 0, sd, np.nan))
            m = K.gmm(z, k, seed + i + 1000, 5, w=w)
            return gate, i, adjusted_rand(m.predict(z)[0], y, w), m.converged
        n = int(w.sum())
        drawn = np.zeros(n, bool)
        drawn[rng.integers(0, n, n)] = True
        many = np.add.reduceat(drawn, np.concatenate([[0], np.cumsum(w)[:-1]]).astype(np.int64), dtype=np.int64)  # of each row's samples
        rows = many > 0
        if many.sum() < 2 * k:
            return gate, i, 0.0, False
        m = K.gmm(x[rows], k, seed + i + 2000, 5, w=many[rows])
        return gate, i, adjusted_rand(m.predict(x[rows])[0], y[rows], many[rows]), m.converged

    runs = [(g, i) for g, n in (("label_shuffle", n_permutations), ("random_gene_sets", n_permutations), ("bootstrap", n_bootstrap)) for i in range(n)]
    data = (p.x, p.w, p.more["cluster"], p.more["burdens"])
    table = run_all(spark, data, runs, "gate string, i int", fit, "gate string, i int, ari double, converged boolean")
    means = table.groupBy("gate").agg(F.avg(F.when(F.col("converged"), F.col("ari"))).alias("m"))
    found = {r["gate"]: r["m"] for r in means.collect()}
    rows = []
    for gate in ("label_shuffle", "random_gene_sets"):
        m = 1.0 if found.get(gate) is None else found[gate]
        rows.append((gate, float(m), null_ari_max, bool(m < null_ari_max)))
    m = found.get("bootstrap") or 0.0
    rows.append(("bootstrap", float(m), stability_min, bool(m >= stability_min)))
    if pcs is not None:
        p = independence(labels, pcs)
        least = p.agg(F.min("p"), F.count(F.lit(1))).first()
        rows.append(("ancestry_independence", float(least[0]), 0.05 / max(1, least[1]), bool(least[0] > 0.05 / max(1, least[1]))))
    return spark.createDataFrame(rows, "name string, metric double, threshold double, passed boolean")


def independence(labels: DataFrame, pcs: DataFrame, n_pcs: int = 5) -> DataFrame:
    """pc, h, p of a Kruskal-Wallis test of each of the first n_pcs components over the clusters, by sample_id."""
    from ..functions.distributions import chi2_sf
    from .inference import kruskal_wallis

    number = F.regexp_extract("pc", r"(\d+)$", 1).try_cast("int")
    first = pcs.where(F.coalesce(number, F.lit(0)) <= n_pcs)
    joined = first.join(labels.select("sample_id", F.col("cluster").alias("grp")), "sample_id")
    tests = kruskal_wallis(joined.select("sample_id", "grp", F.col("pc").alias("pathway"), F.col("value").alias("score")))
    return tests.select(F.col("pathway").alias("pc"), "h", F.when(F.col("df") > 0, chi2_sf(F.col("h"), F.col("df").cast("double"))).otherwise(F.lit(1.0)).alias("p"))


def planted(n: int, d: int, k: int, effect: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Standard normal data whose cluster j is shifted by effect in every k-th dimension from j."""
    y = rng.permutation(np.arange(n) % k)
    x = rng.normal(size=(n, d))
    for j in range(k):
        x[np.ix_(y == j, np.arange(d) % k == j)] += effect
    return x, y


def simulate_thresholds(spark: SparkSession, n: int, k: int, d: int = 15, n_simulations: int = 200, n_stability: int | None = None, n_bootstrap: int = 10, effect: float = 1.5, seed: int = 42) -> DataFrame:
    """One row: the 95th percentile of the null ARI and the 5th of the bootstrap ARI of planted clusters."""

    def fit(_, run):
        kind, i = run
        rng = np.random.default_rng((seed, i, len(kind)))
        if kind == "null":
            x = rng.normal(size=(n, d))
            m = K.gmm(x, k, seed + i, 5)
            return [(kind, adjusted_rand(m.predict(x)[0], rng.integers(0, k, n)))] if m.converged else []
        x, _ = planted(n, d, k, effect, rng)
        whole = K.gmm(x, k, seed + i, 5).predict(x)[0]
        out = []
        for b in range(n_bootstrap):
            rows = np.unique(rng.integers(0, n, n))
            m = K.gmm(x[rows], k, seed + b, 5)
            if m.converged:
                out.append((kind, adjusted_rand(m.predict(x[rows])[0], whole[rows])))
        return out

    n_stability = max(5, n_simulations // 10) if n_stability is None else n_stability
    runs = [("null", i) for i in range(n_simulations)] + [("stability", i) for i in range(n_stability)]
    table = run_all(spark, None, runs, "kind string, i int", fit, "kind string, ari double")
    pick = lambda kind, p, other: F.coalesce(F.percentile(F.when(F.col("kind") == kind, F.col("ari")), p), F.lit(other))
    return table.agg(pick("null", 0.95, 0.15).alias("null_ari"), pick("stability", 0.05, 0.8).alias("stability"))


def calibrate(spark: SparkSession, n: int, k: int, alpha: float = 0.05, method: str = "auto", **options) -> DataFrame:
    """null_ari and stability: from the grid, if n and k are inside it, else (or with "simulate") by simulation."""
    from .crossref import interpolate_thresholds, threshold_grid

    out = None
    if method != "simulate":
        out = interpolate_thresholds(spark.createDataFrame([(n, k)], "n int, k int"), threshold_grid(spark)).select("null_ari", "stability")
        if out.first()["null_ari"] is None:
            if method == "lookup":
                raise ValueError(f"n={n}, k={k} is outside the grid")
            out = None
    if out is None:
        return simulate_thresholds(spark, n, k, **options)
    ratio = alpha / 0.05
    return out.select((F.col("null_ari") * ratio).alias("null_ari"), (1 - (1 - F.col("stability")) * ratio).alias("stability"))


#: The thresholds that held before there was a table of them.
LEGACY = {"null_ari": 0.15, "stability": 0.8}


def threshold_table(spark: SparkSession, samples: Iterable[int], clusters: Iterable[int], **options) -> DataFrame:
    """n, k, null_ari, stability by simulation of each pair: what the grid was made from. A pair is a row of its own; the
    simulations of one are spread over the cluster."""
    out = [simulate_thresholds(spark, n, k, **options).select(F.lit(n).alias("n"), F.lit(k).alias("k"), "null_ari", "stability") for n in samples for k in clusters]
    return reduce(DataFrame.unionByName, out)


def sensitivity(scores: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """parameter, config, other, ari: all pairs of clusterings with another algorithm, number of clusters, set of
    pathways or normalisation."""
    p = points(scores)
    names = p.names
    runs = [("algorithm", a, a) for a in K.ALGORITHMS] + [("n_clusters", str(j), str(j)) for j in range(max(2, k - 1), k + 3)]
    runs += [("features", "all", "")] + [("features", f"without {p}", p) for p in names]
    runs += [("normalisation", m, m) for m in ("zscore", "minmax", "robust", "rank")]

    def fit(d, run):
        parameter, config, value = run
        x, w, names = d
        if parameter == "algorithm":
            labels = K.cluster(x, k, value, seed, 5, w)[0]
        elif parameter == "n_clusters":
            labels = K.cluster(x, int(value), "gmm", seed, 5, w)[0]
        elif parameter == "features":
            labels = K.cluster(x[:, [i for i, p in enumerate(names) if p != value]], k, "gmm", seed, 5, w)[0]
        else:
            labels = K.cluster(normalised(x, value, w), k, "gmm", seed, 5, w)[0]
        return parameter, config, labels.tolist()

    fits = run_all(scores.sparkSession, (p.x, p.w, names), runs, "parameter string, config string, value string", fit, "parameter string, config string, labels array<int>")
    found: dict[str, list] = {}
    for r in fits.collect():  # a few dozen label vectors of a matrix under MAX_CELLS
        found.setdefault(r["parameter"], []).append((r["config"], np.array(r["labels"])))
    rows = []
    for parameter, many in found.items():
        many.sort(key=lambda c: c[0])
        rows += [(parameter, a, b, adjusted_rand(y, z, p.w)) for i, (a, y) in enumerate(many) for b, z in many[i + 1 :]]
    return scores.sparkSession.createDataFrame(rows, "parameter string, config string, other string, ari double")


def sensitivity_summary(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """parameter, mean_ari, min_ari, and over all parameters overall and is_robust."""
    by = pairs.groupBy("parameter").agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"))
    total = by.agg(F.avg("mean_ari").alias("overall"))
    return by.join(F.broadcast(total)).withColumn("is_robust", F.col("overall") >= threshold)


def normalised(x: np.ndarray, method: str, w: np.ndarray | None = None) -> np.ndarray:
    w = np.ones(len(x)) if w is None else w
    if method == "zscore":
        mean = w @ x / w.sum()
        sd = np.sqrt(w @ (x - mean) ** 2 / (w.sum() - 1))
        return np.where(sd > 0, (x - mean) / np.where(sd > 0, sd, 1), x)
    if method == "minmax":
        span = np.ptp(x, axis=0)
        return np.where(span > 0, (x - x.min(0)) / np.where(span > 0, span, 1), x)
    order = np.argsort(x, 0, kind="stable")
    values, upto = np.take_along_axis(x, order, 0), np.cumsum(w[order], 0)
    if method == "robust":
        def at(share: float) -> np.ndarray:
            place = share * (w.sum() - 1)
            low, high = (np.array([v[np.searchsorted(u, i, "right")] for v, u in zip(values.T, upto.T, strict=True)]) for i in (np.floor(place), np.ceil(place)))
            return low + (high - low) * (place - np.floor(place))

        a, b, c = at(0.25), at(0.5), at(0.75)
        return np.where(c > a, (x - b) / np.where(c > a, c - a, 1), x)
    out = np.empty_like(x)
    for j, (v, u) in enumerate(zip(values.T, upto.T, strict=True)):  # the mean rank of equal values
        first, last = np.searchsorted(v, v, "left"), np.searchsorted(v, v, "right") - 1
        out[order[:, j], j] = (np.concatenate([[0.0], u])[first] + 1 + u[last]) / 2 / w.sum()
    return out


METHODS = ("pathway_gmm", "nmf", "pca_kmeans", "gene_kmeans", "random")


def benchmark(scores: DataFrame, burden: DataFrame, k: int, truth: DataFrame | None = None, methods: Iterable[str] = METHODS, seed: int = 42) -> DataFrame:
    """method, ari (null without truth), silhouette in the space of pathways, place: by ARI, else by silhouette."""
    genes = names_of(burden, "gene")
    own = wide(burden, genes, "sample_id", "gene", "burden").withColumnRenamed("x", "burdens")
    samples = scores.select("sample_id").distinct()
    burdens = samples.join(own, "sample_id", "left").withColumn("burdens", F.coalesce("burdens", F.array_repeat(F.lit(0.0), len(genes))))
    more = {"burdens": burdens}
    if truth is not None:
        more["truth"] = truth.select("sample_id", F.col("truth").cast("string").alias("truth"))
    p = points(scores, **more)
    y = p.more.get("truth")

    def fit(d, run):
        x, w, b, y = d
        if run[0] == "random":  # each sample its own label: a row's samples fall into several
            many = np.random.default_rng(seed).multinomial(w.astype(np.int64), np.full(k, 1 / k))
            rows, labels = np.nonzero(many)
            w = many[rows, labels].astype(float)
            x, y = x[rows], None if y is None else y[rows]
        else:
            labels = method_labels(run[0], x, b, k, seed, w)
        return run[0], None if y is None else adjusted_rand(labels, y, w), K.quality(x, labels, w)[0]

    data = (p.x, p.w, p.more["burdens"], y)
    table = cut(run_all(scores.sparkSession, data, [(m,) for m in methods], "method string", fit, "method string, ari double, silhouette double"))
    from pyspark.sql import Window

    order = Window.orderBy(F.coalesce("ari" if y is not None else "silhouette", F.lit(-1.0)).desc(), "method")
    return table.withColumn("place", F.row_number().over(order))


def method_labels(method: str, x: np.ndarray, b: np.ndarray, k: int, seed: int, w: np.ndarray | None = None) -> np.ndarray:
    if method == "pathway_gmm":
        return K.cluster(x, k, "gmm", seed, w=w)[0]
    if method == "nmf":
        return K.kmeans(K.nmf(b, k, w=w)[0], k, seed, w=w)[0]
    if method == "pca_kmeans":
        return K.kmeans(K.pca(x, min(k, x.shape[1]), w)[0], k, seed, w=w)[0]
    if method == "gene_kmeans":
        return K.kmeans(b, k, seed, w=w)[0]
    raise ValueError(f"unknown method {method}")


def compare_cohorts(scores_a: DataFrame, labels_a: DataFrame, scores_b: DataFrame, labels_b: DataFrame, seed: int = 42) -> DataFrame:
    """One row: transfer_ari (a's mixture on b), projection_ari (nearest of a's centroids in common components) and
    pathway_correlation (of the variances), over the common pathways; at least two are needed."""
    common = sorted(set(names_of(scores_a)) & set(names_of(scores_b)))
    if len(common) < 2:
        raise ValueError("fewer than two common pathways")
    a, b = points(scores_a, names=common, cluster=labels_a), points(scores_b, names=common, cluster=labels_b)
    ya, yb = a.more["cluster"], b.more["cluster"]
    names = np.unique(ya)
    transfer = adjusted_rand(K.gmm(a.x, len(names), seed, w=a.w).predict(b.x)[0], yb, b.w)
    z = K.pca(np.vstack([a.x, b.x]), min(10, len(common)), np.concatenate([a.w, b.w]))[0]
    za, zb = z[: len(a.x)], z[len(a.x) :]
    centres = np.array([a.w[ya == c] @ za[ya == c] / a.w[ya == c].sum() for c in names])
    near = names[((zb[:, None] - centres[None]) ** 2).sum(2).argmin(1)]
    va, vb = (p.w @ (p.x - p.w @ p.x / p.n) ** 2 / (p.n - 1) for p in (a, b))
    r = float(np.corrcoef(va, vb)[0, 1]) if va.std() > 0 and vb.std() > 0 else 0.0
    row = (transfer, adjusted_rand(near, yb, b.w), r, len(common))
    return scores_a.sparkSession.createDataFrame([row], "transfer_ari double, projection_ari double, pathway_correlation double, n_common int")


def type_one_error(spark: SparkSession, n: int = 100, d: int = 15, k: int = 3, threshold: float = 0.15, n_simulations: int = 100, seed: int = 42) -> DataFrame:
    """One row: mean and sd of the null ARI and the share over threshold."""

    def fit(_, run):
        rng = np.random.default_rng((seed, run[0]))
        x = rng.normal(size=(n, d))
        return (adjusted_rand(K.gmm(x, k, seed + run[0], 5).predict(x)[0], rng.integers(0, k, n)),)

    table = run_all(spark, None, [(i,) for i in range(n_simulations)], "i int", fit, "ari double")
    return table.agg(F.avg("ari").alias("mean"), F.stddev_pop("ari").alias("sd"), F.avg((F.col("ari") > threshold).cast("double")).alias("type_i_rate"))


def power_curve(spark: SparkSession, points: Iterable[tuple[int, float]], d: int = 15, k: int = 3, threshold: float = 0.8, n_simulations: int = 50, seed: int = 42) -> DataFrame:
    """n, effect, power for each (samples, effect size): the share of simulations that find the planted clusters."""

    def fit(_, run):
        n, effect, i = run
        x, y = planted(n, d, k, effect, np.random.default_rng((seed, i, n, int(1000 * effect))))
        return n, effect, adjusted_rand(K.gmm(x, k, seed + i, 5).predict(x)[0], y)

    runs = [(int(n), float(e), i) for n, e in points for i in range(n_simulations)]
    table = run_all(spark, None, runs, "n int, effect double, i int", fit, "n int, effect double, ari double")
    return table.groupBy("n", "effect").agg(F.avg((F.col("ari") >= threshold).cast("double")).alias("power"), F.avg("ari").alias("mean_ari"))


def smallest_powered(curve: DataFrame, column: str, power: float = 0.8) -> DataFrame:
    """One row: the first value of column whose power is at least that; null if none is."""
    return curve.where(F.col("power") >= power).agg(F.min(column).alias(column))


def ancestry_components(genotypes: DataFrame, samples: DataFrame, k: int = 10) -> DataFrame:
    """sample_id, pc, value, ratio: components of standardised dosages (sd by n; constant variants and missing are 0).

    Made from the samples' Gram matrix, whose sums Spark takes over all variants, if samples by samples fit MAX_CELLS; of
    more samples by passes over the variants that multiply with it (``_by_passes``).
    """
    spark = genotypes.sparkSession
    n = samples.select("sample_id").distinct().count()
    stats = genotypes.groupBy("variant_id").agg(F.sum("dosage").alias("s"), F.sum(F.col("dosage") * F.col("dosage")).alias("ss"))
    stats = stats.select("variant_id", (F.col("s") / n).alias("mu"), F.sqrt(F.greatest(F.col("ss") / n - F.pow(F.col("s") / n, 2), F.lit(0.0))).alias("sd")).where("sd > 0")
    g = genotypes.where("dosage is not null and dosage != 0").join(stats, "variant_id").select("variant_id", "sample_id", (F.col("dosage") / F.col("sd")).alias("v"), (F.col("mu") / F.col("sd")).alias("m"))
    if n * n > MAX_CELLS:
        return _by_passes(g, samples, stats.count() * n, n, k)
    # (g_i - m)(g_j - m) = g_i g_j - m g_i - m g_j + m m: sums over stored dosages only.
    a, b = g.alias("a"), g.alias("b")
    cross = a.join(b, (F.col("a.variant_id") == F.col("b.variant_id")) & (F.col("a.sample_id") <= F.col("b.sample_id")))
    pairs = cross.groupBy(F.col("a.sample_id").alias("i"), F.col("b.sample_id").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("s"))
    own = g.groupBy("sample_id").agg(F.sum(F.col("v") * F.col("m")).alias("t"))
    whole = stats.agg(F.sum(F.pow(F.col("mu") / F.col("sd"), 2))).first()[0] or 0.0
    ids = sorted(r["sample_id"] for r in samples.select("sample_id").distinct().collect())
    at = {s: i for i, s in enumerate(ids)}
    gram = np.full((n, n), whole)
    t = np.zeros(n)
    for r in own.collect():
        t[at[r["sample_id"]]] = r["t"]
    gram -= t[:, None] + t[None]
    for r in pairs.toPandas().itertuples(index=False):
        i, j = at[r.i], at[r.j]
        gram[i, j] += r.s
        if i != j:
            gram[j, i] += r.s
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][: min(k, n)]
    total = max(values.sum(), 1e-300)
    rows = []
    for c, o in enumerate(order):
        v = vectors[:, o] * np.sqrt(max(values[o], 0))
        v = v * (np.sign(v[np.abs(v).argmax()]) or 1)
        rows += [(s, f"PC{c + 1}", float(v[i]), float(max(values[o], 0) / total)) for i, s in enumerate(ids)]
    return spark.createDataFrame(rows, f"sample_id {samples.schema['sample_id'].dataType.simpleString()}, pc string, value double, ratio double")


def _by_passes(g: DataFrame, samples: DataFrame, total: float, n: int, k: int, more: int = 10, passes: int = 20, tol: float = 1e-6, seed: int = 42) -> DataFrame:
    """The components of g (variant_id, sample_id, v, m) by block Krylov spaces: a pass multiplies k + more vectors with the
    Gram matrix, variant by variant. It ends when the residuals of k vectors are under tol, or after ``passes``: where
    eigenvalues lie close together the last ones are then approximate, as those of randomised methods are, but orthogonal.
    The driver holds samples by k + more numbers for each pass."""
    spark, kind = g.sparkSession, samples.schema["sample_id"].dataType.simpleString()
    ids = sorted(r["sample_id"] for r in samples.select("sample_id").distinct().collect())
    places = spark.createDataFrame(list(zip(ids, range(n), strict=True)), f"sample_id {kind}, i int")
    entry = F.collect_list(F.struct("i", "v"))
    rows = g.join(broadcast_if_small(places, 1_000_000), "sample_id").groupBy("variant_id").agg(F.first("m").alias("m"), entry.alias("e"))
    rows = cut(rows.select("m", F.col("e.i").alias("i"), F.col("e.v").alias("v")))

    def times(q: np.ndarray) -> np.ndarray:
        shared, b = spark.sparkContext.broadcast(q), q.shape[1]

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, out = shared.value, np.zeros((n, b))
            whole = q.sum(0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                m, i, v = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten()), np.asarray(batch.column(2).flatten())
                size = np.asarray(batch.column(1).value_lengths())
                t = np.add.reduceat(v[:, None] * q[i], np.cumsum(size) - size, 0) - m[:, None] * whole
                of = np.repeat(np.arange(len(size)), size)
                for c in range(b):
                    out[:, c] += np.bincount(i, v * t[of, c], n)
                out -= m @ t
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32))] + [pa.array(c) for c in out.T], ["i"] + [f"y{c}" for c in range(b)])

        names = [f"y{c}" for c in range(b)]
        sums = rows.mapInArrow(products, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
        found = sums.toArrow().combine_chunks()
        out = np.zeros((n, b))
        out[np.asarray(found["i"])] = np.column_stack([np.asarray(found[c]) for c in names])
        shared.destroy()
        return out

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, k + more))))[0]
    basis, image = q[:, :0], q[:, :0]
    while True:
        y = times(q)
        basis, image = np.hstack([basis, q]), np.hstack([image, y])
        values, u = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, u = values[::-1][:k], u[:, ::-1][:, :k]
        vectors = basis @ u
        passes -= 1
        if not passes or basis.shape[1] + q.shape[1] > n or np.linalg.norm(image @ u - vectors * values, axis=0).max() < tol * max(values[0], 1e-300):
            break
        for _ in range(2):
            y = y - basis @ (basis.T @ y)
            y = np.linalg.qr(y)[0]
        q = y
    vectors = np.linalg.qr(vectors)[0]  # to the last digit
    out = []
    for c, value in enumerate(values):
        v = vectors[:, c] * np.sqrt(max(value, 0))
        v = v * (np.sign(v[np.abs(v).argmax()]) or 1)
        out.append(pa.table({"sample_id": ids, "pc": [f"PC{c + 1}"] * n, "value": v, "ratio": np.full(n, max(value, 0) / max(total, 1e-300))}))
    return spark.createDataFrame(pa.concat_tables(out)).select(F.col("sample_id").cast(kind).alias("sample_id"), "pc", "value", "ratio")


def regress_out(scores: DataFrame, pcs: DataFrame, n_pcs: int = 10, confounded: float = 0.1) -> DataFrame:
    """sample_id, pathway, score (residual as z-score), r2, confounded: least squares on the components, by sample_id.

    Normal equations: sums by pathway of products go to one small solve for each pathway; samples never meet.
    """
    number = F.coalesce(F.regexp_extract("pc", r"(\d+)$", 1).try_cast("int"), F.lit(1))
    wide = pcs.where(number <= n_pcs).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(number.alias("i"), "value"))).alias("v"))
    x = wide.select("sample_id", F.concat(F.array(F.lit(1.0).cast("double")), F.transform("v", lambda p: p["value"])).alias("x"))
    joined = scores.join(x, "sample_id")
    parts = joined.select("pathway", F.col("score").cast("double"), "x").mapInArrow(_gram_blocks, "pathway string, k int, terms array<double>")
    fit = parts.groupBy("pathway").applyInPandas(_solve, "pathway string, beta array<double>")  # a row a task that has some
    fit = broadcast_if_small(cut(fit), 1_000_000)
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0).cast("double"), lambda s, v: s + v)
    res = joined.join(fit, "pathway").select("sample_id", "pathway", "score", (F.col("score") - dot).alias("res"))
    stats = res.groupBy("pathway").agg(F.avg("res").alias("mu"), F.stddev_samp("res").alias("sd"), F.var_pop("res").alias("vr"), F.var_pop("score").alias("vs"))
    r2 = F.greatest(F.lit(0.0), F.coalesce(1 - F.try_divide(F.col("vr"), F.col("vs")), F.lit(0.0)))
    z = (F.col("res") - F.col("mu")) / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(F.lit(1.0))
    return res.join(broadcast_if_small(cut(stats), 1_000_000), "pathway").select("sample_id", "pathway", z.alias("score"), r2.alias("r2"), (r2 > confounded).alias("confounded"))


def _gram_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pathway, score, x) -> for each pathway of a task the products of x with itself and with the score, summed up: the
    rows of a batch that belong to a pathway are one block of a matrix, multiplied as a whole."""
    sums: dict[str, np.ndarray] = {}

    def result() -> pa.RecordBatch:
        ks = [x.shape[0] for x in sums.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(ks, pa.int32()), pa.array([x.ravel() for x in sums.values()], pa.list_(pa.float64()))], ["pathway", "k", "terms"])

    for batch in batches:
        whole = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
        if not whole.num_rows:
            continue
        names, rows = whole.column(0).dictionary_encode(), whole.column(2)
        size = np.asarray(rows.value_lengths())
        wide = np.zeros((whole.num_rows, int(size.max()) + 1))
        wide[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.nan_to_num(np.asarray(rows.flatten().cast(pa.float64())))
        wide[:, -1] = np.asarray(whole.column(1))
        codes = np.asarray(names.indices)
        order = np.argsort(codes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
            m = wide[part]
            gram, name = np.ascontiguousarray(m[:, :-1].T @ m), names.dictionary[codes[part[0]]].as_py()
            sums[name] = _added(sums[name], gram) if name in sums else gram
        if len(sums) > 20_000:
            yield result()
            sums.clear()
    yield result()


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of k by k + 1 blocks of any k; the last column is that of the score."""
    if len(a) < len(b):
        a, b = b, a
    out, k = a.copy(), len(b)
    out[:k, :k] += b[:, :-1]
    out[:k, -1] += b[:, -1]
    return out


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    total = reduce(_added, (np.asarray(t).reshape(k, k + 1) for k, t in zip(pdf["k"], pdf["terms"], strict=True)))
    return pd.DataFrame({"pathway": [pdf["pathway"].iloc[0]], "beta": [np.linalg.lstsq(total[:, :-1], total[:, -1], rcond=None)[0].tolist()]})


def stratified(scores: DataFrame, groups: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """grp, n, silhouette, concordance: a mixture in each group of at least 3 k samples; concordance is the mean over its
    centroids of the best correlation with one of another group's."""
    joined = scores.join(groups, "sample_id")
    centres, out = {}, []
    sizes = {r["grp"]: r["n"] for r in groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    for grp in sorted(sizes):
        if sizes[grp] < 3 * k:
            continue
        p = points(joined.where(F.col("grp") == grp))
        labels = K.cluster(p.x, k, "gmm", seed, w=p.w)[0]
        centres[grp] = np.array([p.w[labels == c] @ p.x[labels == c] / p.w[labels == c].sum() for c in np.unique(labels)])
        out.append((grp, sizes[grp], K.quality(p.x, labels, p.w)[0]))
    rows = []
    for grp, n, s in out:
        others = [np.max([np.corrcoef(c, o)[0, 1] for o in centres[h]]) for h in centres if h != grp for c in centres[grp]]
        rows.append((grp, n, s, float(np.nanmean(others)) if others else None))
    return scores.sparkSession.createDataFrame(rows, "grp string, n long, silhouette double, concordance double")

