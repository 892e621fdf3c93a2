"""What takes the place of one task's window, matrix or file, and the parts of a run that stand beside its tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veltra import pipeline, session
from veltra.functions.distributions import adjusted_rand
from veltra.operators import bundles, clustering, resample
from veltra.progress import Progress
from veltra.sources import variants


def test_numbers_follow_the_order(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(5000).tolist()
    df = spark.createDataFrame([(v, v % 7) for v in values], "x int, g int").repartition(6)
    found = {r.x: r.i for r in session.numbered(df, "g", "x").collect()}
    assert [x for x, _ in sorted(found.items(), key=lambda p: p[1])] == sorted(values, key=lambda v: (v % 7, v))
    assert sorted(found.values()) == list(range(5000))
    assert session.numbered(df.limit(0), "x").count() == 0


def test_folds_and_permutations_of_any_number(spark):
    for n in (1, 3, 11):
        samples = spark.range(n).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("string").alias("grp"))
        sizes = sorted((r["count"] for r in resample.folds(samples, 5).groupBy("fold").count().collect()), reverse=True)
        assert sum(sizes) == n and sizes == [n // 5 + (i < n % 5) for i in range(len(sizes))]
        dealt = resample.permuted(samples, 4).groupBy("it", "grp").count().collect()
        expected = {r.grp: r["count"] for r in samples.groupBy("grp").count().collect()}
        assert all(expected[r.grp] == r["count"] for r in dealt) and len(dealt) == 4 * len(expected)


def test_scores_beyond_the_matrix_bound_are_clustered(spark, monkeypatch):
    monkeypatch.setattr(clustering, "MAX_CELLS", 10)
    rng = np.random.default_rng(2)
    y = np.arange(240) % 3
    x = 100 + rng.normal(0, 0.5, (240, 4)) + 4 * np.eye(4)[y]
    rows = [(i, f"P{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    scores = spark.createDataFrame(rows, "sample_id int, pathway string, score double")
    for k in (3, None):
        found = {r.sample_id: (r.cluster, r.confidence) for r in clustering.assign(scores, k, range(2, 5)).collect()}
        assert adjusted_rand(np.array([found[i][0] for i in range(240)]), y) == 1.0 and all(c > 0.99 for _, c in found.values())


def test_methods_on_all_pairs_refuse_too_many_rows(monkeypatch):
    from veltra.operators import mlkit

    monkeypatch.setattr(mlkit, "MAX_PAIRS", 100)
    for name in ("hierarchical", "spectral"):
        with pytest.raises(ValueError, match="too many"):
            mlkit.cluster(np.zeros((11, 2)), 2, name)


def test_strict_quality_report(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n"
    line = "1\t{}\t.\tA\tC\t50\tPASS\tGENE={};CADD=3\tGT\t0/1\t0/0\n"
    path = tmp_path / "a.vcf"
    path.write_text(head + "".join(line.format(i, "G" if i < 3 else ".") for i in range(5)))
    tables = variants.read_vcf(spark, str(path))
    assert variants.quality_report(tables, strict=True).is_usable
    assert not variants.quality_report(tables, min_gene_coverage=80).is_usable
    with pytest.raises(variants.VcfError, match="80"):
        variants.quality_report(tables, min_gene_coverage=80, strict=True)
    path.write_text(head + line.format(1, "G") + "short\n")
    with pytest.raises(variants.VcfError, match="fewer than 9"):
        variants.quality_report(variants.read_vcf(spark, str(path)), strict=True)


def test_digests_tell_other_lines_apart(spark, tmp_path):
    a, b, c = (tmp_path / x for x in "abc")
    a.write_text("x\ny\nx\n")
    b.write_text("y\nx\nx\n")
    c.write_text("y\nx\n")
    found = list(pipeline.file_digests(spark, [str(a), str(b), str(c)]).values())
    assert found[0] == found[1] != found[2] and all(len(x) == 64 for x in found)
    assert set(pipeline.versions()) == {"python", "pyspark", "numpy", "commit"}


def test_report_of_cohorts(spark, tmp_path):
    rows = [("a", "b", 0.9, 0.8, 0.5, 4)]
    df = spark.createDataFrame(rows, "cohort_a string, cohort_b string, transfer_ari double, projection_ari double, pathway_correlation double, n_common int")
    bundles.write_cohort_report(df, str(tmp_path / "r.md"))
    text = (tmp_path / "r.md").read_text()
    assert "| a, b | 0.900 | 0.800 | 0.500 |" in text and "subtypes replicate." in text
    bundles.write_cohort_report(df.withColumn("transfer_ari", F.lit(0.0)).withColumn("projection_ari", F.lit(0.1)), str(tmp_path / "r.md"))
    assert "don't replicate" in (tmp_path / "r.md").read_text()


def test_validation_text():
    gates = [{"name": "label_shuffle", "metric": 0.05, "threshold": 0.15, "passed": True}, {"name": "bootstrap", "metric": None, "threshold": 0.8, "passed": False}]
    text = pipeline.validation_text(gates)
    assert "| label_shuffle | 0.0500 | 0.1500 | yes |" in text and "| bootstrap | - | 0.8000 | no |" in text
    assert text.endswith("Not passed: bootstrap. The subtypes should not be relied on.")
    assert pipeline.validation_text(gates[:1]).endswith("All 1 gates passed.")
    assert pipeline.validation_text([], "no burdens") == "No gate was run: no burdens." and pipeline.validation_text([]) == "No gate was run."


def test_reference_data_sets_are_kept_and_unpacked(tmp_path, monkeypatch):
    import io
    import zipfile

    from veltra.sources import datasets

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("sets.gmt", "A\tb\tC\n")
    asked = []

    def opened(url, timeout):
        asked.append(url)
        return io.BytesIO(packed.getvalue() if url.endswith(".zip") else b"#Symbol\n")

    monkeypatch.setattr(datasets.urllib.request, "urlopen", opened)
    for _ in range(2):
        path = datasets.fetch("reactome_pathways", str(tmp_path / "cache"))
        assert path.endswith("sets.gmt") and open(path).read() == "A\tb\tC\n"
    assert len(asked) == 1
    plain = datasets.fetch("clinvar_gene_summary", str(tmp_path / "cache"))
    assert open(plain).read() == "#Symbol\n" and datasets.fetch("clinvar_gene_summary", str(tmp_path / "cache"), force=True) == plain
    assert len(asked) == 3


def test_memory_of_a_run():
    small, large = bundles.memory_estimate(10, 100, 5, 2), bundles.memory_estimate(1000, 100_000, 5, 2)
    assert set(small) == set(large) and all(0 <= small[k] <= large[k] for k in small)


def test_progress():
    told, time = [], iter(range(0, 100, 2))
    p = Progress(4, lambda *x: told.append(x), clock=lambda: next(time))
    assert list(p.over("abcd")) == list("abcd")
    assert told == [(1, 4, 2, 6.0), (2, 4, 4, 4.0), (3, 4, 6, 2.0), (4, 4, 8, 0.0)]


def test_metadata_of_a_run(spark, tmp_path):
    from veltra.config import validate

    rng = np.random.default_rng(0)
    genes = [f"{p}{i}" for p in "ABC" for i in range(4)]
    samples = [f"sample-{i}" for i in range(36)]
    lines = ["id," + ",".join(f"GEN{g}" for g in genes)]
    lines += [s + "," + ",".join(f"{5 * (g[0] == 'ABC'[i % 3]) + rng.random():.3f}" for g in genes) for i, s in enumerate(samples)]
    (tmp_path / "e.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "g.gmt").write_text("".join(f"SET{p}\td\t" + "\t".join(f"GEN{g}" for g in genes if g[0] == p) + "\n" for p in "ABC"))
    (tmp_path / "pcs.csv").write_text("sample,PC1\n" + "".join(f"{s},{i // 3 % 2}\n" for i, s in enumerate(samples)))
    config = {"pipeline": {"output_dir": str(tmp_path / "out")}, "data": {"input_type": "expression", "expression_path": str(tmp_path / "e.csv"), "pathway_db": str(tmp_path / "g.gmt")}}
    config |= {"clustering": {"n_clusters": 3}, "ancestry": {"pcs_path": str(tmp_path / "pcs.csv"), "correction": "stratified"}}
    result = pipeline.run(spark, validate(config))
    assert {s["grp"] for s in result.report["ancestry"]["strata"]} <= {"low", "high"}
    assert "burdens" in result.report["validation_gates_left_out"]
    meta = json.loads((tmp_path / "out" / "metadata.json").read_text())
    assert len(meta["inputs"]) == 3 and meta["versions"]["pyspark"]
