"""Operators on inputs beyond what one task, one line of a table or one call a key could hold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veltra.operators import agreement, clustering, mlkit
from veltra.sources import tables
from veltra.streaming import keyed


def test_silhouette_by_blocks_of_points(spark):
    rng = np.random.default_rng(4)
    y = np.arange(150) % 4
    y[:1] = 7  # alone in its cluster
    for width in (3, 40):
        x = rng.normal(0, 1, (150, width)) + 2 * np.eye(width)[y % 3]
        x[5] = x[1]
        rows = [(i, r.tolist(), f"c{c}") for i, (r, c) in enumerate(zip(x, y, strict=True))]
        points = spark.createDataFrame([*rows, (900, None, "c1")], "id int, features array<double>, label string")
        found = {r.id: r.silhouette for r in agreement.silhouette(points, block=16).collect()}
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        for i in (0, 1, 5, 77):
            own = (y == y[i]) & (np.arange(150) != i)
            a, b = d[i, own].mean() if own.any() else 0, min(d[i, y == c].mean() for c in set(y.tolist()) - {y[i]})
            assert found[i] == pytest.approx((b - a) / max(a, b) if own.any() else 0.0, abs=1e-12)
        assert len(found) == 151 and found[900] == 0.0
        assert np.mean([found[i] for i in range(150)]) == pytest.approx(mlkit.quality(x, y)[0])


def test_expression_of_more_samples_than_a_table_has_columns(spark, tmp_path):
    n = 21_000
    path = tmp_path / "e.csv"
    lines = ["id," + ",".join(f"sample-{i}" for i in range(n))]
    lines += [f"GEN{g}," + ",".join("NA" if i % 7 == g else str(i * g) for i in range(n)) for g in range(2, 4)]
    path.write_text("\n".join(lines) + '\n\n"GEN9",1,"2"\n')
    found = {(r.sample_id, r.gene): r.value for r in tables.read_expression(spark, str(path)).collect()}
    assert len(found) == 3 * n
    assert found["sample-20999", "GEN3"] == 62997.0 and found["sample-2", "GEN2"] == 0.0
    assert [found[f"sample-{i}", "GEN9"] for i in range(3)] == [1.0, 2.0, 0.0]


def test_a_batch_asks_for_one_state_a_sample():
    """All genes and variants of a sample are one state, read and written once a batch."""
    calls = []

    class Value:
        kept = None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, value):
            calls.append("update")
            self.kept = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    p = keyed.CappedBurden(3)
    p.init(Handle())
    part = pd.DataFrame([(f"G{v % 5}", v, f"e{v}-{i}", 0.5) for v in range(20) for i in range(4)], columns=["gene", "variant_id", "event", "weight"])
    for again in (False, True):
        out = list(p.handleInputRows((1,), iter([part[:30], part[30:]]), None))
        assert out == [] if again else dict(zip(out[0]["gene"], out[0]["burden"], strict=True)) == {f"G{g}": 6.0 for g in range(5)}
    assert calls == ["get", "update", "get"]


def test_components_of_more_samples_than_a_matrix_holds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    groups = rng.random((4, 300))
    g = rng.binomial(2, groups[np.arange(80) % 4])
    df = spark.createDataFrame([(f"v{j}", i, int(g[i, j])) for i in range(80) for j in range(300) if g[i, j]], "variant_id string, sample_id int, dosage int")
    samples = spark.range(80).select(F.col("id").cast("int").alias("sample_id"))
    key = lambda df: {(r.sample_id, r.pc): (r.value, r.ratio) for r in df.collect()}
    whole = key(clustering.ancestry_components(df, samples, 3))
    monkeypatch.setattr(clustering, "MAX_CELLS", 100)
    found = key(clustering.ancestry_components(df, samples, 3))
    assert found.keys() == whole.keys()
    assert all(found[c] == pytest.approx(whole[c], abs=1e-3) for c in whole)
