import numpy as np
import pytest

from veltra.operators import clustering
from veltra.plans import modelling, planted

SF = "/root/testdata/sf0.001"


def test_large_mixture_runs_beyond_the_small_bound(spark, monkeypatch):
    monkeypatch.setattr(clustering, "MAX_CELLS", 1)
    rows = modelling.gmm_assign_large(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count() and len({r.cluster for r in rows}) > 1


def test_number_of_clusters_is_chosen_of_the_whole_range(spark, monkeypatch):
    tried, fit = [], clustering.mixtures_large

    def noted(points, n, ks, *args):
        tried.extend(ks)
        return fit(points, n, ks, *args)

    monkeypatch.setattr(clustering, "mixtures_large", noted)
    rows = planted.gmm_large_chooses_k(spark, SF).collect()
    assert tried == list(range(2, 9))
    assert all((r.sample_id - r.first_member) % 3 == 0 for r in rows) and len({r.first_member for r in rows}) == 3


def test_mixtures_side_by_side_are_those_alone(spark):
    x = np.random.default_rng(1).normal(size=(400, 3)) + np.repeat([[0, 0, 0], [3, 0, 2]], 200, axis=0)
    points = clustering.cut(spark.createDataFrame(list(enumerate(x.tolist())), "sample_id long, x array<double>"))
    for k, fit in zip([2, 4], clustering.mixtures_large(points, 400, [2, 4]), strict=True):
        alone = clustering.mixtures_large(points, 400, [k])[0]
        assert len(fit.weights) == k and fit.converged and alone.converged
        assert fit.loglik == pytest.approx(alone.loglik) and np.allclose(fit.means, alone.means)
