"""Clusterings, gates and cohort comparisons on planted groups, whose right answers SQL can tell.

A supplier (or customer) is a sample of the group that its key leaves modulo 3. Its score in pathway j is 4 if j leaves
the same modulo 3, plus a part between 0 and 1 that the key and j determine: groups lie some ten deviations apart, so
that every method has to find them, each cluster is known by its first member, and quality figures are those of the
planted groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement as AG
from ..operators import bundles
from ..operators import clustering as CL
from ..operators import simulate as S
from ..session import table
from .analogue import rounded
from .registry import query
from .statistics import ORACLES

PATHWAYS = 6
NAMES = [f"P{j}" for j in range(PATHWAYS)]


def _score(key: Column, j: Column) -> Column:
    return F.when(F.pmod(key, F.lit(3)) == j % 3, 4.0).otherwise(0.0) + F.pmod(key * (13 + 6 * j) + 7 * j, F.lit(101)) / 101.0


def planted(spark: SparkSession, sf: str, name: str = "supplier", key: str = "s_suppkey", pathways: int = PATHWAYS) -> DataFrame:
    """(sample_id, grp, pathway, score)."""
    rows = table(spark, sf, name).select(F.col(key).alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(pathways - 1))).alias("j"))
    return rows.select(
        "sample_id", F.pmod("sample_id", F.lit(3)).cast("int").alias("grp"), F.concat(F.lit("P"), F.col("j").cast("string")).alias("pathway"), _score(F.col("sample_id"), F.col("j")).alias("score")
    )


def scores(spark, sf, *source) -> DataFrame:
    return planted(spark, sf, *source).drop("grp")


def planted_sql(name: str = "supplier", key: str = "s_suppkey", pathways: int = PATHWAYS, where: str = "true") -> str:
    return f"""SELECT {key} AS sample_id, ({key} % 3)::INT AS grp, 'P' || j AS pathway, j, (CASE WHEN {key} % 3 = j % 3 THEN 4.0 ELSE 0.0 END)::DOUBLE
 + (({key} * (13 + 6 * j) + 7 * j) % 101) / 101.0::DOUBLE AS score FROM {name}, range(0, {pathways}) t(j) WHERE {where}"""


def first_members(labels: DataFrame, *by: str) -> DataFrame:
    """A cluster's number is arbitrary, its first member is not."""
    first = labels.groupBy(*by, "cluster").agg(F.min("sample_id").alias("first_member"))
    return labels.join(first, [*by, "cluster"]).select(*by, "sample_id", "first_member")


def _partition(name: str, key: str) -> str:
    return f"SELECT {key} AS sample_id, min({key}) OVER (PARTITION BY {key} % 3) AS first_member FROM {name}"


CUSTOMERS, SUPPLIERS = ("customer", "c_custkey"), ("supplier", "s_suppkey")


@query("gmm_assign", _partition(*CUSTOMERS))
def gmm_assign(spark: SparkSession, sf: str) -> DataFrame:
    return first_members(CL.assign(scores(spark, sf, *CUSTOMERS), 3))


@query("gmm_assign_large", _partition(*CUSTOMERS))
def gmm_assign_large(spark, sf):
    return first_members(CL.assign_large(scores(spark, sf, *CUSTOMERS), NAMES, 3))


@query("gmm_large_chooses_k", _partition(*CUSTOMERS))
def gmm_large_chooses_k(spark, sf):
    """Without a number of clusters, by the criterion, of all that the operator tries. It is one for normal groups: what the
    other queries add to a score lies on a lattice, which it would rather describe by more than three."""
    j = F.substring("pathway", 2, 9).cast("int")
    score = F.when(F.col("grp") == j % 3, 4.0).otherwise(0.0) + 0.3 * S.normal(42, "sample_id", j)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    normal = planted(spark, sf, *CUSTOMERS).repartition(n, "sample_id").withColumn("score", score).drop("grp")  # draws take time, a small file is one task
    return first_members(CL.assign_large(normal, NAMES, None))


@query("kmeans_large", _partition(*CUSTOMERS))
def kmeans_large(spark, sf):
    return first_members(CL.assign_large(scores(spark, sf, *CUSTOMERS), NAMES, 3, "kmeans"))


ALGORITHMS = "(VALUES ('gmm'), ('kmeans'), ('hierarchical'), ('spectral')) a(algorithm)"


@query("clusters_by_algorithm", f"SELECT algorithm, p.* FROM ({_partition(*SUPPLIERS)}) p, {ALGORITHMS}")
def clusters_by_algorithm(spark, sf):
    return first_members(CL.labels_by_algorithm(scores(spark, sf), 3), "algorithm")


FEATURES = f"""WITH planted AS ({planted_sql()}), points AS (SELECT sample_id AS id, grp AS label, list(score ORDER BY j) AS features FROM planted GROUP BY 1, 2)"""
D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
SILHOUETTE = f""", d AS (SELECT a.id, a.label, b.label AS l, sqrt({D2.format(a="a.features", b="b.features")}) AS d FROM points a CROSS JOIN points b),
 s AS (SELECT id, label, l, sum(d) AS s, count(*) AS n FROM d GROUP BY 1, 2, 3),
 ab AS (SELECT id, any_value(label) AS label, max(CASE WHEN l = label THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN l <> label THEN s / n END) AS b FROM s GROUP BY 1),
 sil AS (SELECT id, label, coalesce((b - a) / greatest(a, b), 0) AS silhouette FROM ab)"""
QUALITY = f""", u AS (SELECT id, label, unnest(features) AS x, generate_subscripts(features, 1) AS i FROM points),
 cm AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM u GROUP BY 1, 2), c AS (SELECT label, any_value(n) AS n, list(m ORDER BY i) AS c FROM cm GROUP BY 1),
 gm AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x) AS m FROM u GROUP BY 1)),
 w AS (SELECT p.label, sum({D2.format(a="p.features", b="c.c")}) AS ssw, avg(sqrt({D2.format(a="p.features", b="c.c")})) AS s FROM points p JOIN c USING (label) GROUP BY 1),
 k AS (SELECT label, n, c, ssw, s FROM c JOIN w USING (label)), db AS (SELECT a.label, max((a.s + b.s) / sqrt({D2.format(a="a.c", b="b.c")})) AS r FROM k a JOIN k b ON a.label <> b.label GROUP BY 1),
 q AS (SELECT (sum(n * {D2.format(a="c", b="g")}) / (count(*) - 1)) / (sum(ssw) / (sum(n) - count(*))) AS ch, (SELECT avg(r) FROM db) AS db FROM k, gm)"""


@query(
    "algorithm_comparison",
    FEATURES + SILHOUETTE + QUALITY + f""", a AS (SELECT algorithm, CASE algorithm WHEN 'gmm' THEN 0 WHEN 'kmeans' THEN 1 WHEN 'hierarchical' THEN 2 ELSE 3 END AS i FROM {ALGORITHMS})
 SELECT x.algorithm, y.algorithm AS other, 1.0::DOUBLE AS ari, round((SELECT avg(silhouette) FROM sil), 6) AS silhouette, round(q.ch, 4) AS calinski_harabasz, round(q.db, 6) AS davies_bouldin FROM a x JOIN a y ON x.i < y.i, q""",
)
def algorithm_comparison(spark, sf):
    out = CL.compare_algorithms(scores(spark, sf), 3)
    return rounded(out, "ari", "silhouette", "davies_bouldin").withColumn("calinski_harabasz", F.round("calinski_harabasz", 4))


@query("model_selection", FEATURES + SILHOUETTE + " SELECT 3 AS k, round(avg(silhouette), 6) AS silhouette FROM sil")
def model_selection(spark, sf):
    """Of two to five clusters the planted three have the largest silhouette."""
    found = CL.select_k(scores(spark, sf), range(2, 6), "silhouette")
    return rounded(found.where("chosen").select("k", "silhouette"), "silhouette")


@query(
    "mixture_bic",
    f"""WITH p AS ({planted_sql(*CUSTOMERS, pathways=2)}), x AS (SELECT sample_id, grp, max(score) FILTER (j = 0) AS a, max(score) FILTER (j = 1) AS b FROM p GROUP BY 1, 2),
 g AS (SELECT grp, count(*)::DOUBLE AS n, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab FROM x GROUP BY 1),
 r AS (SELECT *, (saa + 1e-6) * (sbb + 1e-6) - sab * sab AS det, ((sbb + 1e-6) * saa + (saa + 1e-6) * sbb - 2 * sab * sab) * n AS trace FROM g),
 t AS (SELECT sum(n) AS n FROM g)
 SELECT 3 AS k, round(-2 * sum(r.n * (ln(r.n / t.n) - ln(2 * pi()) - 0.5 * ln(det)) - 0.5 * trace / det) + 17 * ln(any_value(t.n)), 3) AS bic FROM r, t""",
)
def mixture_bic(spark, sf):
    """The criterion of a mixture with full covariances, in two dimensions."""
    found = CL.select_k(planted(spark, sf, *CUSTOMERS, 2).drop("grp"), [3])
    return found.select("k", F.round("bic", 3).alias("bic"))


@query("cross_validation", "SELECT i::INT AS fold, 1.0::DOUBLE AS ari FROM range(0, 5) t(i)")
def cross_validation(spark, sf):
    return rounded(CL.cross_validate(scores(spark, sf, *CUSTOMERS), 3), "ari")


KW3 = """, r AS (SELECT grp, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rank, count(*) OVER (PARTITION BY x) AS t FROM v),
 s AS (SELECT grp, sum(rank) AS r, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 2), tt AS (SELECT sum(t::DOUBLE * t - 1) AS tie, count(*)::DOUBLE AS n FROM r),
 kw AS (SELECT (12 / (any_value(tt.n) * (any_value(tt.n) + 1)) * sum(r * r / s.n) - 3 * (any_value(tt.n) + 1)) / (1 - any_value(tie) / (any_value(tt.n) ^ 3 - any_value(tt.n))) AS h, count(*) - 1 AS df FROM s, tt)"""


def _gates(spark, sf):
    p = scores(spark, sf, *SUPPLIERS)
    labels = CL.assign(p, 3)
    c = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), "s_acctbal")
    # Burdens that have nothing to do with the groups.
    genes = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("g")
    burden = c.select("sample_id", genes).select(
        "sample_id", F.format_string("G%02d", F.col("g")).alias("gene"), (F.pmod((F.col("sample_id") + 17) * (F.col("sample_id") + 5 * F.col("g")), F.lit(97)) / 97.0).alias("burden")
    )
    membership = spark.createDataFrame([(f"S{g % 6}", f"G{g:02d}") for g in range(24)], "pathway string, gene string")
    pcs = c.select("sample_id", F.lit("PC1").alias("pc"), F.col("s_acctbal").alias("value"))
    return CL.gates(p, labels, burden, membership, 3, 100, 50, pcs=pcs)


@query(
    "validation_gates",
    f"""WITH v AS (SELECT s_suppkey % 3 AS grp, s_acctbal AS x FROM supplier){KW3}
 SELECT * FROM (VALUES ('label_shuffle', 0.15::DOUBLE, NULL::DOUBLE, true), ('random_gene_sets', 0.15, NULL, true), ('bootstrap', 0.8, 1.0, true)) g(name, threshold, metric, passed)
 UNION ALL SELECT 'ancestry_independence', 0.05, round(exp(-h / 2), 6), exp(-h / 2) > 0.05 FROM kw""",
)
def validation_gates(spark, sf):
    """Clusters that are there pass all gates, with the default number of iterations; the null gates' means are near zero
    but depend on draws, so that only their verdicts are compared."""
    null = F.col("name").isin("label_shuffle", "random_gene_sets")
    return _gates(spark, sf).withColumn("metric", F.when(F.col("name") == "bootstrap", F.round("metric", 1)).when(~null, F.round("metric", 6)))


@query("recovery", "SELECT 1.0::DOUBLE AS ari, 1.0::DOUBLE AS nmi, count(DISTINCT c_custkey % 3) AS k_predicted, count(DISTINCT c_custkey % 3) AS k_true, true AS correct_k FROM customer")
def recovery(spark, sf):
    p = planted(spark, sf, *CUSTOMERS)
    truth = p.select("sample_id", F.col("grp").alias("truth")).distinct()
    return rounded(bundles.recovery(CL.assign(p.drop("grp"), 3).join(truth, "sample_id")), "ari", "nmi")


def _cohort_of(spark, sf, part: int, parts: int):
    """The customers whose key, without its group, leaves part; and their clusters."""
    p = scores(spark, sf, *CUSTOMERS).where(F.floor(F.col("sample_id") / 3) % parts == part)
    return p, CL.assign(p, 3)


def _comparison_sql(parts: int) -> str:
    variances = " UNION ALL ".join(
        f"SELECT {i} AS cohort, pathway, var_samp(score) AS v FROM ({planted_sql(*CUSTOMERS, where=f'(c_custkey // 3) % {parts} = {i}')}) GROUP BY pathway" for i in range(parts)
    )
    return f"""SELECT 'c' || a.cohort AS cohort_a, 'c' || b.cohort AS cohort_b, 1.0::DOUBLE AS transfer_ari, 1.0::DOUBLE AS projection_ari, round(corr(a.v, b.v), 6) AS pathway_correlation, count(*)::INT AS n_common
 FROM ({variances}) a JOIN ({variances}) b ON a.pathway = b.pathway AND a.cohort < b.cohort GROUP BY 1, 2"""


@query("cohort_comparison", f"SELECT * EXCLUDE (cohort_a, cohort_b) FROM ({_comparison_sql(2)})")
def cohort_comparison(spark, sf):
    (a, la), (b, lb) = _cohort_of(spark, sf, 0, 2), _cohort_of(spark, sf, 1, 2)
    return rounded(CL.compare_cohorts(a, la, b, lb), "transfer_ari", "projection_ari", "pathway_correlation")


@query("all_cohort_pairs", _comparison_sql(3))
def all_cohort_pairs(spark, sf):
    out = bundles.compare_all_cohorts({f"c{i}": _cohort_of(spark, sf, i, 3) for i in range(3)})
    return rounded(out, "transfer_ari", "projection_ari", "pathway_correlation")


@query("shared_labels", "SELECT 'P' || (n_nationkey % 5) AS cluster_label FROM nation WHERE n_regionkey < 3 INTERSECT SELECT 'P' || (n_nationkey % 5) FROM nation WHERE n_regionkey >= 2")
def shared_labels(spark, sf):
    n = table(spark, sf, "nation").select("n_regionkey", F.concat(F.lit("P"), (F.col("n_nationkey") % 5).cast("string")).alias("cluster_label"))
    return bundles.shared_subtypes(n.where("n_regionkey < 3"), n.where("n_regionkey >= 2"))


@query(
    "sensitivity",
    """SELECT parameter, 1.0::DOUBLE AS mean_ari, 1.0::DOUBLE AS min_ari, n FROM (VALUES ('algorithm', 6), ('features', 21), ('normalisation', 3)) v(parameter, n)""",
)
def sensitivity(spark, sf):
    """All pairs of clusterings that should agree: other algorithms, a pathway less, other scales. Clusterings into other
    numbers of clusters cannot, and ranks take the distance between groups away."""
    pairs = CL.sensitivity(scores(spark, sf), 3).where("parameter != 'n_clusters' and config != 'rank' and other != 'rank'")
    found = pairs.groupBy("parameter").agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"), F.count(F.lit(1)).cast("int").alias("n"))
    return rounded(found, "mean_ari", "min_ari")


@query(
    "benchmark_comparison",
    FEATURES + SILHOUETTE + """ SELECT method, 1.0::DOUBLE AS ari, round((SELECT avg(silhouette) FROM sil), 6) AS silhouette, place FROM (VALUES ('gene_kmeans', 1), ('nmf', 2), ('pathway_gmm', 3), ('pca_kmeans', 4)) v(method, place)""",
)
def benchmark_comparison(spark, sf):
    """Every method finds the planted groups; random labels, the last place, depend on draws."""
    p = planted(spark, sf)
    burden = p.select("sample_id", F.explode(F.array(*[F.concat("pathway", F.lit(f"_{g}")) for g in range(3)])).alias("gene"), F.col("score").alias("burden"))
    truth = p.select("sample_id", F.col("grp").cast("string").alias("truth")).distinct()
    out = CL.benchmark(p.drop("grp"), burden, 3, truth).where("method != 'random'")
    return rounded(out, "ari", "silhouette")


@query(
    "stratified_clusters",
    FEATURES.replace("WITH planted AS", "WITH everyone AS").replace(", points AS", ", planted AS (SELECT *, (sample_id // 3) % 2 AS stratum FROM everyone), points AS").replace("SELECT sample_id AS id, grp AS label", "SELECT sample_id AS id, stratum * 3 + grp AS label").replace("FROM planted GROUP BY", "FROM planted GROUP BY")
    + SILHOUETTE.replace("FROM points a CROSS JOIN points b)", "FROM points a JOIN points b ON a.label // 3 = b.label // 3)")
    + """, c AS (SELECT stratum, grp, pathway, avg(score) AS m FROM planted GROUP BY 1, 2, 3), r AS (SELECT a.stratum, a.grp, max(r) AS r FROM
 (SELECT a.stratum, a.grp, b.grp AS other, corr(a.m, b.m) AS r FROM c a JOIN c b ON a.pathway = b.pathway AND a.stratum <> b.stratum GROUP BY 1, 2, 3) a GROUP BY 1, 2)
 SELECT 'a' || stratum AS grp, n, round(silhouette, 6) AS silhouette, round(r, 6) AS concordance FROM (SELECT label // 3 AS stratum, count(*) AS n, avg(silhouette) AS silhouette FROM sil GROUP BY 1 HAVING count(*) >= 9)
 JOIN (SELECT stratum, avg(r) AS r FROM r GROUP BY 1) USING (stratum)""",
)
def stratified_clusters(spark, sf):
    p = scores(spark, sf)
    strata = p.select("sample_id", F.concat(F.lit("a"), (F.floor(F.col("sample_id") / 3) % 2).cast("string")).alias("grp")).distinct()
    return rounded(CL.stratified(p, strata, 3), "silhouette", "concordance")


@query("power_curve", "SELECT * FROM (VALUES (60, 0.0::DOUBLE, 0.0::DOUBLE), (90, 0.0, 0.0), (60, 8.0, 1.0), (90, 8.0, 1.0)) v(n, effect, power)")
def power_curve(spark, sf):
    """No power without an effect, all with one of eight deviations; the default number of simulations."""
    return CL.power_curve(spark, [(n, e) for e in (0.0, 8.0) for n in (60, 90)], d=6).select("n", "effect", "power")


@query("sample_size_curve", "SELECT 30::INT AS n")
def sample_size_curve(spark, sf):
    """The smallest number of samples with enough power: any, for groups that lie far apart."""
    curve = CL.power_curve(spark, [(n, 8.0) for n in (30, 60, 90)], d=6, n_simulations=20)
    return CL.smallest_powered(curve, "n")


@query("type_one_error", "SELECT 0.0::DOUBLE AS type_i_rate, true AS centred")
def type_one_error(spark, sf):
    """Clusters of noise never agree by half with random labels, and on the mean not at all; the default simulations."""
    found = CL.type_one_error(spark, 100, 6, 3, threshold=0.5)
    return found.select("type_i_rate", (F.abs("mean") < 0.02).alias("centred"))


@query("framework_validation", "SELECT 1.0::DOUBLE AS mean_ari, 1.0::DOUBLE AS power")
def framework_validation(spark, sf):
    return rounded(bundles.validate_framework(spark, 60, 6, 3, 8.0, 10).select("mean_ari", "power"), "mean_ari")


@query("threshold_simulation", "SELECT true AS null_small, true AS stable")
def threshold_simulation(spark, sf):
    """Percentiles of draws: known are their bounds. The default number of simulations."""
    found = CL.simulate_thresholds(spark, 90, 3, 6, effect=8.0)
    return found.select((F.col("null_ari") < 0.15).alias("null_small"), (F.col("stability") > 0.9).alias("stable"))


def cluster_summary_sql() -> str:
    return f"""WITH p AS ({planted_sql(*CUSTOMERS)}) SELECT min(sample_id) AS first_member, count(DISTINCT sample_id) AS n, round(count(DISTINCT sample_id) / (SELECT count(DISTINCT sample_id) FROM p)::DOUBLE, 6) AS share,
 pathway, round(avg(score), 6) AS mean_score FROM p GROUP BY grp, pathway"""


@query("subtype_profiles", cluster_summary_sql())
def subtype_profiles(spark, sf):
    p = scores(spark, sf, *CUSTOMERS)
    labels = first_members(CL.assign(p, 3)).withColumnRenamed("first_member", "cluster")
    return rounded(AG.profiles(p, labels), "share", "mean_score").withColumnRenamed("cluster", "first_member")


@query(
    "assignments_with_truth",
    """SELECT c_custkey AS sample_id, min(c_custkey) OVER (PARTITION BY c_custkey % 3) AS first_member, CASE WHEN c_acctbal > 0 THEN 'g' || (c_custkey % 3) END AS planted_subtype FROM customer""",
)
def assignments_with_truth(spark, sf):
    """Assignments with what is planted, for those samples that have a phenotype."""
    p = planted(spark, sf, *CUSTOMERS)
    known = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("sample_id"), F.concat(F.lit("g"), (F.col("c_custkey") % 3).cast("string")).alias("planted_subtype"))
    return AG.with_truth(first_members(CL.assign(p.drop("grp"), 3)), known)


@query("combined_cohorts", f"WITH p AS ({planted_sql(*CUSTOMERS)}) SELECT 'c' || ((sample_id // 3) % 2) AS cohort, sample_id, pathway, round(score, 6) AS score FROM p WHERE j < 4")
def combined_cohorts(spark, sf):
    """Two cohorts one below the other, with the pathways that both have."""
    p = scores(spark, sf, *CUSTOMERS)
    half = F.floor(F.col("sample_id") / 3) % 2
    a, b = p.where(half == 0).where("pathway < 'P5'"), p.where(half == 1).where("pathway != 'P4'")
    return rounded(CL.combined({"c0": a, "c1": b}), "score")


@query("top_variance_pathways", f"WITH p AS ({planted_sql(*CUSTOMERS, pathways=14)}) SELECT pathway, round(var_samp(score), 6) AS variance, (row_number() OVER (ORDER BY round(var_samp(score), 9) DESC, pathway))::INT AS place FROM p GROUP BY 1 QUALIFY place <= 10")
def top_variance_pathways(spark, sf):
    from ..operators.characterize import top_variance

    return rounded(top_variance(planted(spark, sf, *CUSTOMERS, 14)), "variance")


@query(
    "calibrated_thresholds",
    f"""SELECT n, k, alpha, round(null_ari * alpha / 0.05, 9)::DOUBLE AS null_ari, round(1 - (1 - stability) * alpha / 0.05, 9)::DOUBLE AS stability FROM ({ORACLES["calib_interpolation"]}), (VALUES (0.05::DOUBLE), (0.01)) a(alpha)
 WHERE (n, k) IN ((75, 3), (125, 4), (300, 2))""",
)
def calibrated_thresholds(spark, sf):
    rows = [
        CL.calibrate(spark, n, k, alpha).select(F.lit(n).alias("n"), F.lit(k).alias("k"), F.lit(alpha).alias("alpha"), F.round("null_ari", 9).alias("null_ari"), F.round("stability", 9).alias("stability"))
        for n, k in ((75, 3), (125, 4), (300, 2)) for alpha in (0.05, 0.01)
    ]
    return reduce(DataFrame.unionByName, rows)


@query("threshold_table", "SELECT n::INT AS n, k::INT AS k, true AS in_bounds FROM (VALUES (90), (150)) a(n), (VALUES (2), (3)) b(k)")
def threshold_table(spark, sf):
    """The generator of a calibration table: percentiles of draws, of which the bounds are known."""
    found = CL.threshold_table(spark, (90, 150), (2, 3), d=6, n_simulations=40, effect=8.0)
    return found.select("n", "k", ((F.col("null_ari") < 0.3) & (F.col("stability") > 0.8)).alias("in_bounds"))
