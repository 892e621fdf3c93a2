"""The cohort operators on small fixtures and the sample files' layout."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veltra.config import ConfigError, typed, validate
from veltra.functions import distributions as D
from veltra.functions import genotype as G
from veltra.functions import weights as W
from veltra.operators import agreement, burden, clustering, correction, crossref, expression, inference, mlkit, qc, resample, simulate
from veltra.sources import annotations, genesets, tables, variants

HEADER = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def vcf(tmp_path, rows, samples="S1\tS2\tS3", name="x.vcf"):
    path = tmp_path / name
    text = HEADER + samples + "\n" + "\n".join(rows) + "\n"
    path.write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    return str(path)


def test_genotype_truth_table(spark):
    rows = [("0/0", 1, 0, True), ("0/1", 1, 1, True), ("1/1", 1, 2, True), ("0|1", 1, 1, True), ("0/2", 1, 0, True), ("0/2", 2, 1, True), ("1/2", 1, 1, True), ("1/2", 2, 1, True), ("2/2", 2, 2, True), ("0/1:35:99", 1, 1, True)]
    rows += [(g, 1, 0, False) for g in ("./.", ".", "", "X/Y", "./1", "0", None)]
    df = spark.createDataFrame(rows, "gt string, target int, n int, valid boolean")
    g = G.genotype(F.col("gt"), F.col("target"))
    for r in df.select("*", g["dosage"].alias("d"), g["valid"].alias("v")).collect():
        assert (r.d, r.v) == (r.n, r.valid), r.gt


def test_info(spark):
    texts = ["GENE=SHANK3;CONSEQUENCE=missense_variant;CADD=28.5", "GENE=CHD8;SOMATIC", ".", "AC=10,5;AF=0.1,0.05", "GENE=.;CADD=25", None, "", "A=1;A=2;X=a=b"]
    maps = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(G.info_map(F.col("t"))).collect()]
    assert maps[0] == {"GENE": "SHANK3", "CONSEQUENCE": "missense_variant", "CADD": "28.5"}
    assert maps[1] == {"GENE": "CHD8", "SOMATIC": "true"} and maps[2] == {} and maps[3]["AC"] == "10,5"
    assert maps[4] == {"GENE": None, "CADD": "25"} and maps[5] == {} and maps[6] == {} and maps[7] == {"A": "2", "X": "a=b"}


def burdens(spark, path):
    t = variants.read_vcf(spark, path)
    return {(r.sample_id, r.gene): r.burden for r in burden.gene_burden(t.variants, t.genotypes).collect()}


def test_vcf_burdens(spark, tmp_path):
    rows = ["1\t100\tv1\tA\tG\t50\tPASS\tGENE=SHANK3;CONSEQUENCE=missense_variant;CADD=25\tGT\t0/1\t0/0", "1\t200\tv2\tA\tG\t50\tPASS\tGENE=SHANK3;CONSEQUENCE=frameshift_variant;CADD=35\tGT\t0/1\t0/0", "1\t300\tv3\tA\tG\t.\tPASS\tGENE=CHD8;CONSEQUENCE=missense_variant;CADD=20\tGT\t./.\t0/1"]
    found = burdens(spark, vcf(tmp_path, rows, "S1\tS2"))
    assert found == {("S1", "SHANK3"): pytest.approx(0.9375), ("S2", "CHD8"): pytest.approx(0.05)}
    rows = ["1\t100\tv1\tA\tG\t50\tPASS\tGENE=SHANK3;CONSEQUENCE=stop_gained\tGT\t0/1\t0/0", "1\t200\tv2\tA\tG\t50\tPASS\tGENE=CHD8;CONSEQUENCE=missense_variant\tGT\t0/0\t0/1"]
    found = burdens(spark, vcf(tmp_path, rows, "S1\tS2", "y.vcf.gz"))
    assert found == {("S1", "SHANK3"): pytest.approx(0.875), ("S2", "CHD8"): pytest.approx(0.05)}


def test_multi_allelic_sites_and_quality(spark, tmp_path):
    rows = ["1\t100\tvar1\tA\tG,T\t50\tPASS\tGENE=A;CADD=10,20\tGT:DP:GQ\t0/1:9:30\t0/2:8:20\t1/2:7:10", "1\t200\tshort", ""]
    path = vcf(tmp_path, rows)
    t = variants.read_vcf(spark, path)
    got = {(r.variant_id, r.sample_id): (r.dosage, r.gq, r.dp) for r in t.genotypes.collect()}
    assert [got["var1_1", s][0] for s in ("S1", "S2", "S3")] == [1, 0, 1] and [got["var1_2", s][0] for s in ("S1", "S2", "S3")] == [0, 1, 1]
    assert got["var1_1", "S1"][1:] == (30.0, 9.0)
    assert {r.variant_id: r.cadd for r in t.variants.collect()} == {"var1_1": 10.0, "var1_2": 20.0}
    q = variants.quality_report(t)
    assert (q.total_variants, q.parsed_variants, q.skipped_variants, q.multi_allelic_variants, q.multi_allelic_expanded) == (2, 2, 1, 1, 2) and q.is_usable
    assert variants.read_vcf(spark, path, ["S3"]).samples == ["S3"]
    usable, report, advice = variants.validate_vcf(spark, path)
    assert usable and len(report.warnings) == 3 and len(advice) == 1
    with pytest.raises(variants.VcfError):
        variants.read_vcf(spark, str(tmp_path / "none.vcf") if (tmp_path / "none.vcf").write_text("x\n") else "")


def test_written_vcf_reads_back(spark, tmp_path):
    rows = ["1\t100\tv1\tA\tG\t50\tPASS\tGENE=A;CONSEQUENCE=stop_gained;CADD=10\tGT\t0/1\t0/0\t1/1"]
    t = variants.read_vcf(spark, vcf(tmp_path, rows))
    variants.write_vcf(t.variants, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert line == "1\t100\tv1\tA\tG\t50.0\tPASS\tGENE=A;CONSEQUENCE=stop_gained;CADD=10.0"


def test_weights(spark):
    rows = [("missense_variant", 25.0), ("missense_variant", 14.0), ("inframe_deletion", 26.0), ("splice_donor_variant", 0.0), ("intron", 40.0)]
    df = spark.createDataFrame(rows, "c string, s double")
    got = [r[0] for r in df.select(W.scheme_weight(F.col("c"), F.col("s"), "gnomad_constraint")).collect()]
    assert got == [0.8, 0.05, 0.4, 1.0, 0.05]
    text = spark.createDataFrame([("nonframeshift deletion",), ("",), (None,), ("stopgain SNV",)], "t string")
    assert [r[0] for r in text.select(W.annovar_consequence(F.col("t"))).collect()] == ["inframe_deletion", "unknown", "unknown", "stop_gained"]
    assert text.select(W.annovar_consequence(F.col("t"), frameshift_first=True)).first()[0] == "frameshift_variant"


def test_gene_sets(spark, tmp_path):
    path = tmp_path / "s.gmt"
    path.write_text("#c\n\nA\td\tG1\tG2\tG2\nB\td\tG3\nshort\td\nA\td\tG9\tG8\n")
    rows = sorted((r.pathway, r.ord, r.gene) for r in genesets.read_gmt(spark, str(path)).collect())
    assert rows == [("A", 0, "G9"), ("A", 1, "G8"), ("B", 0, "G3")]
    with pytest.raises(genesets.GmtError, match="duplicate name.*fewer than 2 genes"):
        genesets.validate_gmt(spark, str(path))
    path.write_text("R-HSA-1\tx\tA\tB\nR-MMU-1\tMus\tC\tD\nz\tin Homo sapiens\tE\tF\n")
    assert {r.pathway for r in genesets.read_reactome(spark, str(path)).collect()} == {"R-HSA-1", "z"}
    assert genesets.validate_gmt(spark, str(path)).count() == 6


def test_tables(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("sample_id,sex\nS1,M\nS1,F\nS2,F\n")
    assert {r.sample_id: r.sex for r in tables.read_phenotypes(spark, str(p)).collect()} == {"S1": "M", "S2": "F"}
    p.write_text("id,sex\nS1,M\n")
    with pytest.raises(tables.TableError):
        tables.read_phenotypes(spark, str(p))
    e = tmp_path / "e.tsv"
    e.write_text("gene\tsample-one\tsample-two\nBRCA1\t1\tx\nTP53\t3\t4\n")
    assert sorted(map(tuple, tables.read_expression(spark, str(e)).collect())) == [("sample-one", "BRCA1", 1.0), ("sample-one", "TP53", 3.0), ("sample-two", "BRCA1", 0.0), ("sample-two", "TP53", 4.0)]
    c = tmp_path / "c.tsv"
    c.write_text("junk\n#Symbol\tGeneID\tNumber_Pathogenic\nshank3\t1\t5\nSHANK3\t1\t7\nX\n")
    assert [(r.symbol, r.n_pathogenic) for r in tables.read_clinvar(spark, str(c)).collect()] == [("SHANK3", 7)]


def test_annotation_files(spark, tmp_path):
    v = tmp_path / "v.tsv"
    v.write_text("## x\n#Uploaded_variation\tSYMBOL\tConsequence\tCADD_PHRED\nrs1\tA\tmissense_variant,x\t5\nrs1\tB\tstop_gained\t9\n1:5:A:G\tC\t-\t-\n")
    got = {r.key: (r.gene, r.consequence, r.cadd) for r in annotations.read_vep(spark, str(v)).collect()}
    assert got == {"rs1": ("B", "stop_gained", 9.0), "1:5:A:G": ("C", "", 0.0)}
    rows = ["1\t1\trs1\tA\tG\t50\tPASS\t.\tGT\t0/1\t0/0\t1/1", "1\t5\t.\tA\tG\t50\tPASS\t.\tGT\t0/1\t0/0\t1/1", "1\t6\t.\tA\tG\t50\tPASS\t.\tGT\t0/1\t0/0\t1/1"]
    t = variants.read_vcf(spark, vcf(tmp_path, rows))
    out = {r.pos: r.gene for r in annotations.annotate(t.variants, annotations.read_vep(spark, str(v))).collect()}
    assert out == {1: "B", 5: "C", 6: None}


def labelled(spark, x, groups):
    rows = [(i, g, f"P{j}", float(v)) for i, (r, g) in enumerate(zip(x, groups)) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "sample_id int, grp string, pathway string, score double")


def test_tails():
    assert D.chi2_tail(23.928126979050603, 1) == pytest.approx(1e-6, rel=1e-9)
    assert D.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and D.chi2_tail(4.0, 2) == pytest.approx(math.exp(-2))
    assert D.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05, rel=1e-6) and D.f_tail(0, 2, 3) == 1.0 and math.isnan(D.chi2_tail(float("nan"), 2))


def test_effects_and_ranks(spark):
    one = labelled(spark, [[10.0], [11], [12], [0], [1], [2]], ["a"] * 3 + ["b"] * 3)
    assert inference.max_pairwise_d(one).first().effect_size == pytest.approx(10.0)
    assert inference.one_against_rest(one).where("grp = 'a'").first().effect_size == pytest.approx(10.0)
    same = labelled(spark, [[1.0]] * 4, list("aabb"))
    assert inference.anova(same).first().f_stat == 0 and inference.kruskal_wallis(same).first().h is None
    p = spark.createDataFrame([(f"p{i}", v) for i, v in enumerate([0.001, 0.01, 0.05, 0.2, 0.8])], "pathway string, p double")
    q = [r.q for r in inference.benjamini_hochberg(p).orderBy("pathway").collect()]
    assert q == pytest.approx([0.005, 0.025, 0.25 / 3, 0.25, 0.8])


def test_quality_control(spark):
    sites = spark.createDataFrame([("ok", 50.0), ("het", 50.0), ("low", 10.0)], "variant_id string, qual double")
    rows = [("ok", i, 1 if i < 50 else 2) for i in range(75)] + [("het", i, 1) for i in range(100)] + [("low", 0, 1)]
    g = spark.createDataFrame(rows, "variant_id string, sample_id int, dosage int")
    m = {r.variant_id: r for r in qc.variant_metrics(sites, g, 100).collect()}
    assert m["ok"].hwe_chi2 == pytest.approx(0) and m["het"].hwe_chi2 == pytest.approx(100) and m["low"].maf == pytest.approx(0.005) and m["het"].maf == 0.5
    reasons = {r.variant_id: r.reason for r in qc.removal_reason(qc.variant_metrics(sites, g, 100)).collect()}
    assert reasons == {"ok": "high_maf", "het": "hwe_fail", "low": "low_qual"}


def test_expression_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(f"S{i}", f"G{j}", float(v)) for i, r in enumerate(rng.normal(size=(8, 6))) for j, v in enumerate(r)]
    e = spark.createDataFrame(rows, "sample_id string, gene string, value double")
    all_genes = spark.createDataFrame([("all", f"G{j}") for j in range(6)] + [("two", "G0"), ("two", "G1"), ("one", "G5")], "pathway string, gene string")
    got = {(r.sample_id, r.pathway): r.score for r in expression.ssgsea(e, all_genes).collect()}
    assert len(got) == 16 and all(got[f"S{i}", "all"] == 0 for i in range(8))
    assert expression.transform(e, "counts").count() == 48


def test_batch_correction_takes_batches_out(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "abc"[i % 3], f"P{j}", float(rng.normal() + 3 * (i % 3))) for i in range(90) for j in range(3)]
    b = spark.createDataFrame(rows, "sample_id int, batch string, pathway string, score double")
    for method in correction.METHODS:
        v = correction.validate(b, correction.correct(b, method)).collect()
        assert all(r.eta2_before > 0.7 and r.eta2_after < 0.05 for r in v)
    assert all(r.significant and r.p < 1e-6 for r in correction.batch_effects(b).collect())


def test_thresholds_and_agreement(spark):
    grid = crossref.threshold_grid(spark)
    pts = spark.createDataFrame([(125, 3), (60, 4), (20, 3), (30, 9)], "n int, k int")
    got = {(r.n, r.k): (r.null_ari, r.stability) for r in crossref.interpolate_thresholds(pts, grid).collect()}
    assert got[125, 3] == pytest.approx((0.048, 0.8675)) and got[60, 4] == pytest.approx((0.1232, 0.718)) and got[20, 3] == (None, None) and got[30, 9] == (None, None)
    labels = spark.createDataFrame([(i % 3, i % 3, 0) for i in range(30)], "a int, b int, c int")
    assert agreement.adjusted_rand(labels).first().ari == 1 and agreement.adjusted_rand(labels, "a", "c").first().ari == 0
    assert D.adjusted_rand(np.arange(4), np.arange(4)) == 1


def test_clusterings_find_planted_groups(spark):
    rng = np.random.default_rng(3)
    y = np.repeat([0, 1, 2], 30)
    x = rng.normal(0, 0.5, (90, 5)) + 3 * np.eye(5)[y]
    for name in mlkit.ALGORITHMS:
        assert D.adjusted_rand(mlkit.cluster(x, 3, name)[0], y) > 0.95, name
    s, ch, db = mlkit.quality(x, y)
    points = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id int, features array<double>, label int")
    assert agreement.silhouette(points).agg(F.avg("silhouette")).first()[0] == pytest.approx(s)
    got = agreement.cluster_quality(points).first()
    assert (got.calinski_harabasz, got.davies_bouldin) == (pytest.approx(ch), pytest.approx(db))
    w, h = mlkit.nmf(np.abs(x), 3)
    assert np.linalg.norm(np.abs(x) - w @ h) < 0.4 * np.linalg.norm(x)
    scores = labelled(spark, x, ["-"] * 90).drop("grp")
    chosen = clustering.select_k(scores, range(2, 5)).where("chosen").first()
    assert chosen.k == 3
    adjusted = clustering.regress_out(scores, spark.createDataFrame([(i, "PC1", float(v)) for i, v in enumerate(x[:, 0])], "sample_id int, pc string, value double"))
    assert adjusted.where("pathway = 'P0'").first().r2 == pytest.approx(1.0) and adjusted.where("pathway = 'P0'").first().confounded


def test_components_are_those_of_the_standardised_matrix(spark):
    rng = np.random.default_rng(5)
    g = rng.binomial(2, 0.3, (20, 40))
    rows = [(f"v{j}", i, int(g[i, j])) for i in range(20) for j in range(40) if g[i, j]]
    df = spark.createDataFrame(rows, "variant_id string, sample_id int, dosage int")
    got = clustering.ancestry_components(df, spark.range(20).select(F.col("id").cast("int").alias("sample_id")), 3)
    sd = g.std(0)
    z = (g - g.mean(0))[:, sd > 0] / sd[sd > 0]
    _, s, _ = np.linalg.svd(z, full_matrices=False)
    ratio = {r.pc: r.ratio for r in got.collect()}
    assert [ratio[f"PC{i}"] for i in (1, 2, 3)] == pytest.approx((s[:3] ** 2 / (s**2).sum()).tolist())


def test_simulated_cohorts_and_gates(spark):
    c = simulate.cohort(spark, 90, 6, 8, 3, effect=2.0, noise=0.5, n_ancestry=2, ancestry_effect=0.5, confounding=0.5)
    assert sorted(r["count"] for r in c.truth.groupBy("truth").count().collect()) == [30, 30, 30]
    scores = burden.zscores(burden.pathway_scores(c.burden, c.membership, c.truth))
    labels = clustering.assign(scores, 3)
    joined = labels.join(c.truth, "sample_id")
    assert agreement.adjusted_rand(joined, "cluster", "truth").first().ari > 0.9
    gates = {r.name: r for r in clustering.gates(scores, labels, c.burden, c.membership, 3, 6, 4).collect()}
    assert gates["label_shuffle"].passed and gates["bootstrap"].metric > 0.8
    e, m, t = simulate.expression_cohort(spark, 30, 60, 3, 10)
    assert e.count() == 1800 and m.count() == 30 and t.count() == 30
    assert resample.stratified_downsample(t.select(F.xxhash64("sample_id").alias("sample_id"), "truth"), 10, "truth").count() == 10


def test_config(tmp_path):
    run = typed({"pipeline": {"name": "a"}, "data": {"pathway_db": "x"}, "validation": {"alpha": 0.1}, "burden": {"z": 1}})
    assert (run.name, run.pathway_db, run.validation_alpha) == ("a", "x", 0.1)
    with pytest.raises(ConfigError):
        validate({"pipeline": {}})
    with pytest.raises(ConfigError):
        validate({"pipeline": {}, "data": {"pathway_db": "x", "vcf_path": "y", "input_type": "z"}}, False)
    with pytest.raises(ConfigError):
        validate({"pipeline": {}, "data": {"pathway_db": str(tmp_path / "no"), "vcf_path": "y"}})


def test_whole_run(spark, tmp_path):
    from veltra.pipeline import run

    rng = np.random.default_rng(0)
    genes = [f"{p}{i}" for p in "ABC" for i in range(4)]
    rows = []
    for j, g in enumerate(genes):
        for v in range(3):
            carried = ["0/1" if (i % 3 == "ABC".index(g[0]) and rng.random() < 0.8) or rng.random() < 0.05 else "0/0" for i in range(48)]
            rows.append(f"1\t{j * 10 + v}\tv{j}_{v}\tA\tG\t50\tPASS\tGENE={g};CONSEQUENCE=stop_gained;CADD=30\tGT\t" + "\t".join(carried))
    path = vcf(tmp_path, rows, "\t".join(f"S{i}" for i in range(48)))
    gmt, phenotypes = tmp_path / "g.gmt", tmp_path / "p.csv"
    gmt.write_text("".join(f"{n}\td\t" + "\t".join(x for x in genes if x[0] == p) + "\n" for p, n in zip("ABC", ("SYNAPTIC", "CHROMATIN", "MTOR"))))
    phenotypes.write_text("sample_id,planted_subtype\n" + "".join(f"S{i},{'abc'[i % 3]}\n" for i in range(48)))
    config = validate({"pipeline": {"output_dir": str(tmp_path / "out")}, "data": {"vcf_path": path, "pathway_db": str(gmt), "phenotype_path": str(phenotypes)}, "clustering": {"n_clusters": 3}, "validation": {"n_permutations": 4, "n_bootstrap": 4}})
    result = run(spark, config)
    assert result.report["ground_truth"]["adjusted_rand_index"] == 1.0
    assert {c["cluster_label"] for c in result.report["clusters"]} == {"synaptic", "chromatin", "mtor"}
    assert json.loads((tmp_path / "out" / "report.json").read_text())["n_clusters"] == 3
    scores, assignments = tables.read_scores(spark, str(tmp_path / "out"))
    assert scores.count() == 144 and assignments.count() == 48
