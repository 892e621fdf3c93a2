import hashlib

import numpy as np
import pytest

from veltra.llm import centroid_clusters as C

VECTORS = "vec_id long, embedding array<double>, id string, cluster int, v int"


def brute(rows, k, dim, rounds):
    kept = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        own = [min((apart(v, c), j) for j, c in enumerate(centres))[::-1] for _, v in kept] if centres else []
        if step < rounds:
            for j in range(len(centres)):
                members = [v for (_, v), (c, _) in zip(kept, own, strict=True) if c == j]
                if members:
                    centres[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    spread = [sum(d for c, d in own if c == j) for j in range(len(centres))]
    return sorted(((i, c, d, spread[c], sum(spread), sha[c]) for (i, _), (c, d) in zip(kept, own, strict=True)), key=str)


def found(spark, rows, k, dim, rounds, report=None):
    df = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], VECTORS).repartition(3)
    out = C.cluster_vectors(df, k=k, dim=dim, rounds=rounds, report=report)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("grain", [1.0, 256.0])
def test_equals_brute_force_with_ties(spark, grain):
    """A coarse grain puts vectors on a small lattice, where many centroids are exactly as near."""
    draw = np.random.default_rng(3)
    rows = [(i, (draw.integers(-2, 3, 3) / grain).tolist()) for i in range(250)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]
    assert found(spark, rows, 12, 3, 5) == brute(rows, 12, 3, 5)


def test_bounds_spare_distances(spark):
    draw = np.random.default_rng(4)
    rows = [(i, (draw.normal(0, 0.05, 8) + 3 * np.eye(8)[i % 8]).tolist()) for i in range(400)]
    report = []
    assert found(spark, rows, 8, 8, 5, report) == brute(rows, 8, 8, 5)
    assert report[0][0] == report[0][1] == 400 * 8
    assert all(measured < every / 2 for measured, every in report[2:])


def test_awkward_vectors(spark):
    rows = [(1, [0.0, 0.5]), (1, [0.0, 0.5]), (1, [9.0, 9.0]), (None, [3.0, -3.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0])]
    rows += [(6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [-0.0, -1e-9])]
    assert found(spark, rows, 40, 2, 5) == brute(rows, 40, 2, 5)
    assert found(spark, rows, 2, 2, 1) == brute(rows, 2, 2, 1)
    assert found(spark, [], 40, 2, 5) == []
    assert found(spark, [(None, [1.0, 2.0])], 40, 2, 5) == []  # nothing to start from
    assert found(spark, [(1, [1.0, 2.0]), (2, [1e6, 0.0])], 4, 2, 1) == brute([(1, [1.0, 2.0])], 4, 2, 1)  # beyond 64 bits


def test_rounding_never_raises_a_lower_bound():
    x = np.random.default_rng(5).random(10_000) * 1e6
    low = C._narrow(x)
    assert low.dtype == np.float32 and (low.astype(float) <= x).all()
    n = np.arange(1, 100_000, 7)
    assert all(int(a) ** 2 <= int(s) for a, s in zip(np.floor(C._under(n)), n, strict=True))
    assert (C._under(n) < C._over(n)).all()
