"""Ranks and percentiles of groups that are far more than one task's share."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veltra.operators import order


def frame(spark, rows):
    return spark.createDataFrame(rows, "i long, g string, x double").repartition(5)


def hot_rows():
    rng = np.random.default_rng(0)
    hot = [(i, "hot", float(x)) for i, x in enumerate(rng.permutation(20_000) / 7)]
    ties = [(20_000 + i, "ties", float(x)) for i, x in enumerate(rng.integers(0, 50, 6000))]
    zeros = [(30_000 + i, "zeros", 0.0 if i % 3 else float(i)) for i in range(6000)]
    return [*hot, *ties, *zeros, (1, "one", 5.0), (2, None, 1.0), (3, "hot", None), (4, "none", None)]


def test_ranks_of_hot_groups(spark):
    rows = hot_rows()
    found = {r.i: (r["rank"], r.n, r.ties) for r in order.average_ranks(frame(spark, rows), ["g"], "x").where("g is not null").collect() if r.g != "one"}
    for g in ("hot", "ties", "zeros"):
        own = [(i, x) for i, h, x in rows if h == g and x is not None]
        ranked = sorted(x for _, x in own)
        first, last = {}, {}
        for at, x in enumerate(ranked, 1):
            first.setdefault(x, at)
            last[x] = at
        assert {i: found[i] for i, _ in own} == {i: ((first[x] + last[x]) / 2, len(own), last[x] - first[x] + 1) for i, x in own}
    assert order.average_ranks(frame(spark, []), ["g"], "x").count() == 0


def test_a_hot_group_is_in_many_ranges(spark):
    spread = order.ranges(frame(spark, hot_rows()).where("g = 'hot' and x is not null"), "g", "x").groupBy("__part").count().collect()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(spread) == n and max(r["count"] for r in spread) < 2 * 20_000 / n
    plan = order.running_totals(frame(spark, hot_rows()), ["g"], "x", "i")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "[x#" in line]
    assert windows and all("[__part#" in w for w in windows)  # rows are only ordered inside a range


def test_running_totals(spark):
    df = spark.createDataFrame([("a", i, i % 5) for i in range(3000)] + [("b", 1, 7)], "g string, o int, v long").repartition(7)
    got = {(r.g, r.o): (r.upto, r.total) for r in order.running_totals(df, ["g"], "o", "v").collect()}
    upto = np.cumsum(np.arange(3000) % 5)
    assert got == {("a", i): (int(upto[i]), int(upto[-1])) for i in range(3000)} | {("b", 1): (7, 7)}


@pytest.mark.parametrize(("bins", "few"), [(1024, 4096), (16, 8)])
def test_exact_percentiles(spark, monkeypatch, bins, few):
    monkeypatch.setattr(order, "BINS", bins)
    monkeypatch.setattr(order, "FEW", few)
    rng = np.random.default_rng(1)
    size = 9000 if bins > 16 else 300
    groups = {
        "uniform": rng.random(size), "skewed": np.exp(rng.normal(0, 3, size)), "ties": rng.integers(-2, 3, size).astype(float),
        "zeros": np.where(rng.random(size) < 0.9, 0.0, rng.normal(size=size)), "one": np.array([3.5]), "two": np.array([1.0, 2.0]),
        "wide": np.array([-1.5e308, -1.0, 0.0, 1e-300, 1.0, 1.6e308]), "same": np.full(size, 2.0),
    }
    rows = [(0, g, float(x)) for g, xs in groups.items() for x in xs] + [(0, "one", None), (0, "one", float("nan")), (0, "none", None), (0, None, 1.0)]
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r.g: (r.n, r.q) for r in order.percentiles(frame(spark, rows), ["g"], "x", ps).collect()}
    assert set(found) == set(groups)
    for g, xs in groups.items():
        n, q = found[g]
        s = sorted(xs)
        for p, v in zip(ps, q, strict=True):
            h = (n - 1) * p
            lo, hi = s[math.floor(h)], s[math.ceil(h)]
            assert n == len(xs) and v == pytest.approx(lo if lo == hi else (math.ceil(h) - h) * lo + (h - math.floor(h)) * hi if math.ceil(h) > h else lo, rel=1e-12)
    assert order.percentiles(frame(spark, []), ["g"], "x", ps).count() == 0


def test_more_columns_than_one_tell_a_group(spark):
    df = frame(spark, hot_rows()).where("x is not null and g is not null").withColumn("h", F.col("i") % 2)
    found = {(r.g, r.h): r.q[0] for r in order.percentiles(df, ["g", "h"], "x", [0.5]).collect()}
    exact = {(r.g, r.h): r.m for r in df.groupBy("g", "h").agg(F.percentile("x", 0.5).alias("m")).collect()}
    assert found == pytest.approx(exact)
