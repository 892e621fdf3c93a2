"""The top-1 set join, Gram blocks and keyed state against plain versions."""

import numpy as np
import pytest

from veltra.operators import clustering, crossref
from veltra.streaming import keyed


def plain_best(left, right):
    out = {}
    for name, a in left.items():
        scored = [(-len(a & b) / len(a | b), m) for m, b in right.items() if a & b]
        out[name] = (min(scored)[1], -min(scored)[0]) if scored else (None, 0.0)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_best_match_is_the_plain_one(spark, seed):
    rng = np.random.default_rng(seed)
    genes = np.array([f"G{i}" for i in range(120)])
    skewed = 1 / np.arange(1, 121) ** 0.8
    draw = lambda n: set(rng.choice(genes, n, replace=False, p=skewed / skewed.sum()).tolist())
    left = {f"a{i}": draw(int(rng.integers(1, 40))) for i in range(80)} | {"none": {"X1", "X2"}, "part": {"X1", "G0"}}
    right = {f"b{i}": draw(int(rng.integers(1, 40))) for i in range(90)}
    right |= {"twin": set(right["b3"]), "near": right["b4"] | {"Y"}, "all": set(genes.tolist())}
    left |= {"same": set(right["b3"]), "close": right["b4"] | {"Z"}}
    table = lambda sets: spark.createDataFrame([(k, g.lower() if i % 2 else g) for k, s in sets.items() for i, g in enumerate(sorted(s))], "pathway string, gene string")
    for least in (0.0, 0.1, 0.9):
        got = {r.pathway: (r.match, r.jaccard) for r in crossref.best_jaccard(table(left), table(right), least).collect()}
        want = {k: (m if j >= least else None, j) for k, (m, j) in plain_best(left, right).items()}
        assert got == want
        if least == 0.0:
            assert got["same"] == ("b3", 1.0) and got["none"] == (None, 0.0)


def test_best_match_of_nothing(spark):
    empty = spark.createDataFrame([], "pathway string, gene string")
    some = spark.createDataFrame([("a", "G1")], "pathway string, gene string")
    assert crossref.best_jaccard(empty, some).count() == 0
    assert [tuple(r) for r in crossref.best_jaccard(some, empty).collect()] == [("a", None, 0.0)]


def test_residuals_by_gram_blocks(spark):
    rng = np.random.default_rng(2)
    n, k = 400, 4
    pcs = rng.normal(size=(n, k))
    y = {f"p{j}": pcs @ rng.normal(size=k) + rng.normal(size=n) + j for j in range(3)}
    scores = spark.createDataFrame([(i, p, float(v[i])) for p, v in y.items() for i in range(n)] + [(9999, "p0", 1.0)], "sample_id int, pathway string, score double").repartition(5)
    long = spark.createDataFrame([(i, f"PC{c + 1}", float(pcs[i, c])) for i in range(n) for c in range(k)], "sample_id int, pc string, value double")
    got = {(r.pathway, r.sample_id): (r.score, r.r2) for r in clustering.regress_out(scores, long).collect()}
    assert len(got) == 3 * n
    x = np.column_stack([np.ones(n), pcs])
    for p, v in y.items():
        res = v - x @ np.linalg.lstsq(x, v, rcond=None)[0]
        z = res / res.std(ddof=1)
        assert np.allclose([got[p, i][0] for i in range(n)], z, atol=1e-6)
        assert got[p, 0][1] == pytest.approx(1 - res.var() / v.var())


def test_capped_burden_ignores_replays(spark, tmp_path):
    rows = [
        (1, "A", 10, "e1", 0.5), (1, "A", 10, "e2", 0.5), (1, "A", 10, "e3", 0.5), (1, "A", 11, "e4", 0.25), (1, "B", 12, "e5", 1.0),
        (2, "A", 10, "e6", 0.5), (2, "A", 10, "e6", 0.5),
    ]
    schema = "sample_id long, gene string, variant_id long, event string, weight double"
    folder = str(tmp_path / "run")
    want = {(1, "A"): 1.25, (1, "B"): 1.0, (2, "A"): 0.5}

    def run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        return {(r.sample_id, r.gene): r.burden for r in keyed.run_capped(stream, folder).collect()}

    assert run(rows) == want
    assert run(rows[:4]) == want  # the same observations again, in a later run that goes on from the state
    assert run([(2, "A", 10, "e7", 0.5), (1, "A", 10, "e8", 0.5)]) == {**want, (2, "A"): 1.0}


@pytest.mark.parametrize("cap", [1, 3])
def test_capped_burden_keeps_few_states_for_many_samples(spark, tmp_path, monkeypatch, cap):
    monkeypatch.setattr(keyed, "BUCKETS", 8)
    rng = np.random.default_rng(cap)
    schema = "sample_id long, gene string, variant_id long, event string, weight double"
    kinds = [(int(s), f"G{v % 4}", int(v)) for s, v in zip(rng.integers(0, 300, 600), rng.integers(0, 40, 600), strict=True)]
    seen = [(*kinds[i], f"e{e}", kinds[i][2] / 8) for i, e in zip(rng.integers(0, 600, 3000), rng.integers(0, 4, 3000), strict=True)]
    folder = str(tmp_path / "run")
    for part in (seen[:2000], seen[1000:]):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        got = {(r.sample_id, r.gene): r.burden for r in keyed.run_capped(stream, folder, cap).collect()}
    events, want = {}, {}
    for s, g, v, e, w in seen:
        events.setdefault((s, g, v, w), set()).add(e)
    for (s, g, _, w), of in events.items():
        want[s, g] = want.get((s, g), 0.0) + w * min(cap, len(of))
    assert got == want
    states = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "counted").load()
    assert states.count() == 8
