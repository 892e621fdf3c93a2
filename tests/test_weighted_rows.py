"""Equal samples as one row that counts for all of them, against the rows written out; methods on many rows."""

import numpy as np
import pandas as pd
import pytest

from veltra.functions.distributions import adjusted_rand
from veltra.operators import clustering, mlkit


def copies(seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(60) % 3
    x = np.round(rng.normal(0, 0.5, (60, 4)) + 2 * np.eye(4)[y], 2)
    w = rng.integers(1, 5, 60)
    return x, y, w.astype(float), np.repeat(x, w, 0), lambda v: np.repeat(v, w, 0)


def test_a_row_counts_for_its_copies(monkeypatch):
    x, y, w, every, out = copies()
    for name in mlkit.ALGORITHMS:
        a, b = mlkit.cluster(x, 3, name, w=w), mlkit.cluster(every, 3, name)
        assert adjusted_rand(out(a[0]), b[0]) == 1.0 and a[1] == pytest.approx(b[1]), name
    assert mlkit.quality(x, y, w) == pytest.approx(mlkit.quality(every, out(y)))
    assert np.allclose(out(mlkit.pca(x, 2, w)[0]), mlkit.pca(every, 2)[0]) and np.allclose(out(mlkit.nmf(x, 2, w=w)[0]), mlkit.nmf(every, 2)[0])
    for method in ("zscore", "minmax", "robust", "rank"):
        assert np.allclose(out(clustering.normalised(x, method, w)), clustering.normalised(every, method)), method
    assert np.allclose(clustering.normalised(every, "rank"), pd.DataFrame(every).rank(pct=True).to_numpy())
    whole = mlkit.spectral(x, 3, w=w)
    monkeypatch.setattr(mlkit, "DENSE", 10)
    assert adjusted_rand(mlkit.spectral(x, 3, w=w), whole) == 1.0


def test_all_pairs_of_more_than_ten_thousand_rows():
    rng = np.random.default_rng(1)
    y = np.arange(10_500) % 3
    x = rng.normal(0, 0.1, (len(y), 2)) + 9 * np.eye(3)[y][:, :2]
    assert adjusted_rand(mlkit.ward(x, 3), y) == 1.0


def test_many_equal_samples_are_few_rows(spark, monkeypatch):
    """What is bounded are the cells of rows that differ, not those of samples."""
    monkeypatch.setattr(clustering, "MAX_CELLS", 40 * 4)
    rng = np.random.default_rng(2)
    kinds = rng.normal(0, 0.1, (30, 4)) + 5 * np.eye(4)[np.arange(30) % 3]
    rows = [(i, f"P{j}", float(v)) for i in range(300) for j, v in enumerate(kinds[i % 30])]
    scores = spark.createDataFrame(rows, "sample_id int, pathway string, score double")
    truth = spark.createDataFrame([(i, i % 3) for i in range(300)], "sample_id int, cluster int")
    y = np.arange(300) % 3
    for name, found in clustering.labels_by_algorithm(scores, 3).toPandas().groupby("algorithm"):
        assert len(found) == 300 and adjusted_rand(found.sort_values("sample_id")["cluster"].to_numpy(), y) == 1.0, name
    assert clustering.select_k(scores, [2, 3], "silhouette").where("chosen").first().k == 3
    assert {r.ari for r in clustering.cross_validate(scores, 3).collect()} == {1.0}
    assert {r.ari for r in clustering.compare_algorithms(scores, 3).collect()} == {1.0}
    first, last = scores.where("sample_id < 150"), scores.where("sample_id >= 150")
    row = clustering.compare_cohorts(first, truth, last, truth).first()
    assert (row.transfer_ari, row.projection_ari, row.n_common) == (1.0, 1.0, 4)


def test_samples_are_dealt_without_loss():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 9, 50)
    parts = clustering.dealt(rng, w, [w.sum() - 60, 40, 20])
    assert (parts >= 0).all() and (parts.sum(1) == w).all() and parts.sum(0).tolist() == [w.sum() - 60, 40, 20]


def test_wide_scores(spark, monkeypatch):
    rows = [(1, "b", 2.0), (1, "a", 1.0), (2, "c", float("nan")), (2, "b", 4.0), (3, "c", None)]
    scores = spark.createDataFrame(rows, "sample_id int, pathway string, score double")
    for most in (200, 1):
        monkeypatch.setattr(clustering, "WIDE", most)
        got = {r.sample_id: r.x for r in clustering.wide(scores, ["a", "b", "c"]).collect()}
        assert got == {1: [1.0, 2.0, 0.0], 2: [0.0, 4.0, 0.0], 3: [0.0, 0.0, 0.0]}
