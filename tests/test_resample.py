"""Resampling by matrix products, and samples of strata of any size, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veltra.operators import inference, resample


def test_numbers_are_permuted():
    for n in (1, 2, 3, 64, 1000):
        p = resample.permuted_numbers(np.arange(n), np.arange(1, 40), n)
        assert (np.sort(p, axis=1) == np.arange(n)).all()
    p = resample.permuted_numbers(np.arange(20), np.arange(1, 4001), 20)
    counts = np.array([np.bincount(p[:, i], minlength=20) for i in range(20)])
    assert (((counts - 200) ** 2 / 200).sum(axis=1) < 50).all()  # 19 degrees of freedom
    pairs = np.bincount(p[:, 0] * 20 + p[:, 1], minlength=400)
    assert ((pairs - 4000 / 380) ** 2 / (4000 / 380))[pairs > 0].sum() < 550
    some = np.array([3, 17])
    assert (resample.permuted_numbers(some, np.arange(1, 9), 20) == p[:8][:, some]).all()


def cohort(n=2500, pathways=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(10, 2, (n, pathways))
    g = rng.integers(0, 3, n)
    x[:, 0] += g == 1
    return x, g


def tables(spark, x, g, drop=()):
    rows = [(int(i) * 3, f"p{j:03d}", float(v)) for (i, j), v in np.ndenumerate(x) if (i, j) not in drop]
    scores = spark.createDataFrame([*rows, (5_000_000, "p000", 1.0), (3, "p000", None)], "sample_id long, pathway string, score double").repartition(4)
    labels = spark.createDataFrame([(3 * i, f"g{v}") for i, v in enumerate(g.tolist())], "sample_id long, grp string")
    return scores, labels


def sums_of(df, x):
    mu = {r.pathway: r.m for r in df["scores"].groupBy("pathway").agg(F.avg("score").alias("m")).collect()}
    return {(r.it, r.pathway, r.grp): (r.n, r.s + r.n * mu[r.pathway], r.ss) for r in df["sums"].collect()}


@pytest.mark.parametrize("kind", ["permuted", "bootstrap"])
def test_sums_over_several_blocks(spark, kind):
    x, g = cohort()
    n, its = len(x), 30
    drop = {(7, 1), (8, 1), (9, 1)}
    scores, labels = tables(spark, x, g, drop)
    f = resample.permuted_sums if kind == "permuted" else resample.bootstrap_sums
    found = sums_of({"scores": scores, "sums": f(scores, labels, its)}, x)
    there = np.ones_like(x)
    for at in drop:
        there[at] = 0
    there[1, 0] = 1
    if kind == "permuted":
        p = resample.permuted_numbers(np.arange(n), np.arange(1, its + 1), n)
        dealt = np.sort(g)[p]
        w = [[(dealt[t] == k).astype(float) for k in range(3)] for t in range(its)]
    else:
        w = []
        for t in range(1, its + 1):
            d = resample.mixed_numbers(np.arange(n), np.full(n, t)) % n // resample.SAMPLES
            counts = np.zeros(n)
            for b, c in enumerate(np.bincount(d)):
                size = min(resample.SAMPLES, n - b * resample.SAMPLES)
                np.add.at(counts, b * resample.SAMPLES + resample.mixed_numbers(b * resample.SAMPLES + np.arange(c), np.full(c, t), 43) % size, 1)
            w.append([counts * (g == k) for k in range(3)])
    for t in range(its):
        for j in range(3):
            for k in range(3):
                rows, s, _ = found[t + 1, f"p{j:03d}", f"g{k}"]
                assert rows == (w[t][k] * there[:, j]).sum() and s == pytest.approx((w[t][k] * there[:, j]) @ x[:, j])


def test_many_pathways(spark):
    x, g = cohort(40, 300, 3)
    scores, labels = tables(spark, x, g)
    scores = scores.where("sample_id < 1000000 and score is not null")
    sums = resample.permuted_sums(scores, labels, 4)
    got = {(r.it, r.pathway): r.n for r in sums.groupBy("it", "pathway").agg(F.sum("n").alias("n")).collect()}
    assert got == {(t, f"p{j:03d}"): 40 for t in range(1, 5) for j in range(300)}


def test_draws_are_those_of_a_bootstrap(spark):
    x, g = cohort(1500, 1, 4)
    scores, labels = tables(spark, x, np.zeros(1500, int))
    scores = scores.where("sample_id < 1000000 and score is not null")
    means = np.array([r.s / r.n for r in resample.bootstrap_sums(scores, labels, 400).collect()])
    assert means.std() == pytest.approx(x.std() / np.sqrt(1500), rel=0.15)
    assert abs(means.mean()) < 4 * x.std() / np.sqrt(1500 * 400)


def test_p_values_and_intervals(spark):
    x, g = cohort(300, 3, 5)
    scores, labels = tables(spark, x, g)
    scores = scores.where("score is not null")
    p = {r.pathway: (r.f_stat, r.p) for r in resample.permutation_p(scores, labels, 200).collect()}
    exact = {r.pathway: r.f_stat for r in inference.anova(scores.join(labels, "sample_id")).collect()}
    assert {k: v[0] for k, v in p.items()} == pytest.approx(exact)
    assert p["p000"][1] == 1 / 201 and min(p["p001"][1], p["p002"][1]) > 0.02
    labelled = scores.join(labels, "sample_id")
    d = {r.pathway: r.effect_size for r in inference.max_pairwise_d(labelled).collect()}
    ci = {r.pathway: (r.lo, r.hi) for r in resample.bootstrap_ci(labelled, 200).collect()}
    assert ci["p000"][0] < d["p000"] < ci["p000"][1] and all(lo < hi for lo, hi in ci.values())


def test_empty_and_single(spark):
    x, g = cohort(5, 2, 6)
    scores, labels = tables(spark, x, g)
    assert resample.permutation_p(scores.limit(0), labels, 5).count() == 0
    assert resample.permuted_sums(scores, labels.limit(0), 5).count() == 0
    assert resample.bootstrap_ci(scores.limit(0).join(labels, "sample_id"), 5).count() == 0


def test_stratified_sample_is_the_plain_one(spark):
    rows = [(i, "hot") for i in range(9000)] + [(9000 + i, f"s{i % 3}") for i in range(50)] + [(9100 + i, None) for i in range(30)] + [(1, "hot")]
    df = spark.createDataFrame(rows, "sample_id long, stratum string").repartition(6)
    ids = np.array([r[0] for r in rows])
    mix = resample.mixed_numbers(ids, np.zeros(len(ids), np.int64)).tolist()
    for target in (0, 1, 3, 101, 5200, 20_000):
        order = sorted(range(len(rows)), key=lambda k: (mix[k], rows[k][0]))
        seen, first = {}, []
        for k in order:
            seen[rows[k][1]] = seen.get(rows[k][1], 0) + 1
            if seen[rows[k][1]] <= target // 4:
                first.append(k)
        want = [rows[k] for k in [*first, *[k for k in order if k not in set(first)]][:target]]
        got = [tuple(r) for r in resample.stratified_downsample(df, target, "stratum").collect()]
        assert sorted(got, key=str) == sorted(want, key=str), target
