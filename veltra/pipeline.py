"""The whole run: load, check, score, correct, cluster, test, characterise, write."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import subprocess
import time
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RunConfig
from .functions.weights import subtype_label
from .operators import burden as B
from .operators import characterize as CH
from .operators import clustering as CL
from .operators import expression as E
from .operators import qc
from .operators.order import percentiles
from .session import cut
from .sources import genesets, tables, variants


@dataclass
class RunResult:
    scores: DataFrame
    assignments: DataFrame
    gates: DataFrame | None
    enrichment: DataFrame
    gene_contributions: DataFrame | None
    report: dict[str, Any]


SCORERS = {"ssgsea": E.ssgsea, "gsva": E.gsva, "mean_z": E.mean_z}


def score_expression(expression: DataFrame, membership: DataFrame, input_type: str = "tpm", method: str = "ssgsea", alpha: float = 0.25, min_genes: int = 2) -> DataFrame:
    """Transformed, filtered, scored by the method, z-scored; pathways without spread are dropped."""
    kept = E.filter_genes(E.transform(expression, input_type))
    if method == "ssgsea":
        return B.zscores(E.ssgsea(kept, membership, alpha, min_genes))
    return B.zscores(SCORERS[method](kept, membership, min_genes))


def run(spark: SparkSession, config: RunConfig, write: bool = True) -> RunResult:
    started = time.time()
    membership = genesets.read_gmt(spark, config.pathway_db).select("pathway", "gene")
    burden, quality = None, {}
    if config.input_type == "expression":
        expression = tables.read_expression(spark, config.expression_path)
        samples = expression.select("sample_id").distinct()
        scores = score_expression(expression, membership, config.expression_input_type, config.expression_scoring_method, config.ssgsea_alpha)
    else:
        vcf = variants.read_vcf(spark, config.vcf_path)
        report = variants.quality_report(vcf)
        quality = asdict(report) | {"is_usable": report.is_usable}
        if not report.is_usable:
            raise ValueError("; ".join(report.errors))
        samples = spark.createDataFrame([(s,) for s in vcf.samples], "sample_id string")
        sites, genotypes = vcf.variants, vcf.genotypes
        if config.variant_qc_enabled:
            judged = qc.removal_reason(
                qc.variant_metrics(sites, genotypes, len(vcf.samples)), config.variant_qc_min_qual, config.variant_qc_min_call_rate,
                chi2_threshold(config.variant_qc_hwe_p_threshold), config.variant_qc_max_maf,
            )
            judged = cut(judged)
            quality["removed"] = {r["reason"]: r["count"] for r in judged.where("reason is not null").groupBy("reason").count().collect()}
            sites = qc.filter_variants(judged)
        burden = cut(B.gene_burden(sites, genotypes))
        scores = B.zscores(B.pathway_scores(burden, membership, samples))
    scores = cut(scores)
    n = samples.count()
    n_pathways = scores.select("pathway").distinct().count()
    if n_pathways < 2:
        raise ValueError("fewer than two pathways have scores that differ")
    low, high = config.n_clusters_range
    if n < 2 * (config.n_clusters or high):
        raise ValueError(f"{n} samples are too few for {config.n_clusters or high} clusters")
    pcs, ancestry = None, {}
    if config.ancestry_pcs_path:
        pcs = tables.read_components(spark, config.ancestry_pcs_path)
        if config.ancestry_correction in ("regress_out", "covariate_aware"):
            adjusted = cut(CL.regress_out(scores, pcs, config.ancestry_n_pcs))
            rows = adjusted.select("pathway", "r2", "confounded").distinct().collect()
            ancestry = {"r_squared": {r["pathway"]: round(r["r2"], 4) for r in rows}, "confounded": sorted(r["pathway"] for r in rows if r["confounded"])}
            scores = adjusted.select("sample_id", "pathway", "score")
        elif config.ancestry_correction == "stratified":
            ancestry = {"strata": [r.asDict() for r in stratified_run(scores, pcs, config).collect()]}
    seed = config.seed if config.seed is not None else 0
    clusters = CL.assign(scores, config.n_clusters, range(low, high + 1), seed)
    labelled = scores.join(clusters.select("sample_id", F.col("cluster").cast("string").alias("grp")), "sample_id")
    means = labelled.groupBy("grp", "pathway").agg(F.avg("score").alias("score")).withColumnRenamed("grp", "sample_id")
    tops = B.top_pathway(means).select(F.col("sample_id").alias("grp"), subtype_label(F.col("top_pathway"), F.col("sample_id")).alias("cluster_label"))
    assignments = clusters.join(tops, F.col("cluster").cast("string") == F.col("grp")).select("sample_id", F.col("cluster").alias("cluster_id"), "cluster_label", "confidence")
    truth: dict[str, Any] = {}
    if config.phenotype_path:
        phenotypes = tables.read_phenotypes(spark, config.phenotype_path)
        if "planted_subtype" in phenotypes.columns:
            assignments = assignments.join(phenotypes.select("sample_id", "planted_subtype"), "sample_id", "left")
            from .operators.agreement import adjusted_rand

            both = assignments.where("planted_subtype is not null")
            by_label = adjusted_rand(both, "planted_subtype", "cluster_label").first()["ari"]
            by_id = adjusted_rand(both, "planted_subtype", "cluster_id").first()["ari"]
            truth = {"adjusted_rand_index": round(by_label, 4), "adjusted_rand_index_by_id": round(by_id, 4), "ari_threshold_met": by_label > 0.7}
    k = clusters.select("cluster").distinct().count()
    null_ari, stability, calibration = 0.15, 0.8, {}
    if config.validation_calibrate and config.validation_run_gates:
        found = CL.calibrate(spark, n, k, config.validation_alpha, d=n_pathways).first()
        null_ari, stability = found["null_ari"], found["stability"]
        calibration = {"null_ari": round(null_ari, 4), "stability": round(stability, 4)}
    null_ari = config.validation_null_ari_max if config.validation_null_ari_max is not None else null_ari
    stability = config.validation_stability_threshold if config.validation_stability_threshold is not None else stability
    gate_rows, gates_left_out = None, None
    if config.validation_run_gates and burden is None:
        gates_left_out = "gates need burdens, which an expression matrix doesn't have"
    elif config.validation_run_gates and n * n_pathways > CL.MAX_CELLS:
        gates_left_out = f"{n} samples by {n_pathways} pathways are too many for the fits of the gates"
    elif config.validation_run_gates:
        gate_rows = CL.gates(scores, clusters, burden, membership, k, config.validation_n_permutations, config.validation_n_bootstrap, null_ari, stability, seed, pcs)
    enriched = CH.enrichment(labelled)
    genes = None if burden is None else CH.gene_contributions(burden, clusters.select("sample_id", F.col("cluster").cast("string").alias("grp")))
    report = {
        "pipeline_name": config.name, "input_type": config.input_type, "seed": config.seed, "n_samples": n, "n_pathways": n_pathways, "n_clusters": k,
        "data_quality": quality, "ancestry": ancestry, "calibration": calibration, "ground_truth": truth,
        "clusters": [r.asDict() for r in assignments.groupBy("cluster_id", "cluster_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence")).orderBy("cluster_id").collect()],
        "validation_gates": [] if gate_rows is None else [r.asDict() for r in gate_rows.collect()],
        "validation_gates_left_out": gates_left_out,
        "disclaimer": config.disclaimer,
    }
    result = RunResult(scores, assignments, gate_rows, enriched, genes, report)
    if write:
        write_outputs(spark, config, result, started)
    return result


def stratified_run(scores: DataFrame, pcs: DataFrame, config: RunConfig) -> DataFrame:
    """Clusters in each half of the first component, beside those of all samples."""
    number = F.regexp_extract("pc", r"(\d+)$", 1).try_cast("int")
    first = pcs.where(F.coalesce(number, F.lit(1)) == 1)
    middle = percentiles(first.withColumn("whole", F.lit(1)), ["whole"], "value", [0.5]).select(F.col("q")[0].alias("middle"))
    groups = first.join(F.broadcast(middle)).select("sample_id", F.when(F.col("value") < F.col("middle"), "low").otherwise("high").alias("grp"))
    return CL.stratified(scores, groups, config.n_clusters or config.n_clusters_range[0], config.seed or 0)


def file_digests(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """For each file or folder the SHA-256 of the sorted digests of its lines, summed up in ranges: the same for the same
    lines, wherever they stand; files of any size."""
    out = {}
    for path in paths:
        lines = spark.read.text(path).select(F.sha2("value", 256).alias("h"))
        ranges = lines.groupBy(F.substring("h", 1, 2).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("h", 3, 8), 16, 10).cast("decimal(38,0)")).alias("s"))
        rows = sorted((r["r"], r["n"], str(r["s"])) for r in ranges.collect())  # 256 at most
        out[path] = hashlib.sha256(repr(rows).encode()).hexdigest()
    return out


def versions() -> dict[str, str | None]:
    """Versions of what a result depends on, and the commit of this repository if it is one."""
    import numpy
    import pyspark

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    try:
        done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
        commit = done.stdout.strip() if done.returncode == 0 else None
    except OSError:
        commit = None
    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__, "commit": commit}


def chi2_threshold(p: float) -> float:
    """The statistic whose chi-square tail (one degree of freedom) is p, by bisection; 0 turns the test off."""
    from .functions.distributions import chi2_tail

    if p <= 0:
        return 0.0
    low, high = 0.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, 1) > p else (low, mid)
    return (low + high) / 2


def write_outputs(spark: SparkSession, config: RunConfig, result: RunResult, started: float) -> None:
    """CSV tables, report.json, report.md and metadata.json in the output folder, through Spark's file systems."""
    out = config.output_dir
    csv = lambda df, name: df.write.mode("overwrite").option("header", True).csv(f"{out}/{name}.csv")
    tables.write_wide(result.scores, f"{out}/pathway_scores.csv")
    csv(result.assignments, "subtype_assignments")
    csv(result.enrichment, "pathway_enrichment")
    if result.gene_contributions is not None:
        csv(result.gene_contributions, "gene_contributions")
    heat = CH.heatmap(result.scores.join(result.assignments.select("sample_id", F.col("cluster_label").alias("grp")), "sample_id"))
    csv(heat, "subtype_heatmap")
    text(spark, f"{out}/report.json", json.dumps(result.report, indent=1, default=str))
    text(spark, f"{out}/report.md", markdown(result.report))
    inputs = [p for p in (config.vcf_path, config.expression_path, config.phenotype_path, config.pathway_db, config.ancestry_pcs_path) if p]
    meta = {"seed": config.seed, "runtime_seconds": round(time.time() - started, 2), "config": asdict(config), "inputs": file_digests(spark, inputs), "versions": versions()}
    text(spark, f"{out}/metadata.json", json.dumps(meta, indent=1, default=str))


def text(spark: SparkSession, path: str, content: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(content.encode()))
    stream.close()


def validation_text(gates: list[dict[str, Any]], left_out: str | None = None) -> str:
    """The gates of a run (name, metric, threshold, passed) as a Markdown table, with what they say together."""
    if not gates:
        return "No gate was run" + (f": {left_out}." if left_out else ".")
    figure = lambda x: "-" if x is None else f"{x:.4f}"
    lines = ["| gate | value | threshold | passed |", "|-|-|-|-|"]
    lines += [f"| {g['name']} | {figure(g['metric'])} | {figure(g['threshold'])} | {'yes' if g['passed'] else 'no'} |" for g in gates]
    failed = [g["name"] for g in gates if not g["passed"]]
    said = f"Not passed: {', '.join(failed)}. The subtypes should not be relied on." if failed else f"All {len(gates)} gates passed."
    return "\n".join([*lines, "", said])


def markdown(report: dict[str, Any]) -> str:
    lines = [f"# {report['pipeline_name']}", "", f"{report['n_samples']} samples, {report['n_pathways']} pathways, {report['n_clusters']} clusters.", "", "| cluster | label | samples | confidence |", "|-|-|-|-|"]
    lines += [f"| {c['cluster_id']} | {c['cluster_label']} | {c['n']} | {c['mean_confidence']} |" for c in report["clusters"]]
    lines += ["", "## Validation", "", validation_text(report["validation_gates"], report.get("validation_gates_left_out"))]
    if report["ground_truth"]:
        lines += ["", f"Agreement with the planted subtypes: {report['ground_truth']['adjusted_rand_index']}."]
    return "\n".join([*lines, "", report["disclaimer"], ""])
