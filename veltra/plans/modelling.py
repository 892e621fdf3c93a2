"""Queries whose algorithms SQL cannot express: clusterings, simulations, gates; and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bundles
from ..operators import burden as B
from ..operators import characterize as CH
from ..operators import clustering as CL
from ..operators import correction as CO
from ..operators import simulate as S
from ..session import cut as ensure_cut
from ..session import ensure_checkpoint_dir, table
from . import analogue as A
from .analogue import with_tables
from .registry import query
from .statistics import ANOVA, BH, KW, REST


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings in long form: their planted labels are what clusterings look for."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("i", "x"))
    return e.select("sample_id", F.format_string("D%02d", F.col("i")).alias("pathway"), F.col("x").cast("double").alias("score"))


def reduced_large(scores: DataFrame, pathways: list[str], k: int = 8) -> DataFrame:
    """The first principal components as scores, by pyspark.ml at any size; the driver holds pathways by pathways only."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    wide = scores.groupBy("sample_id").pivot("pathway", pathways).agg(F.first("score")).na.fill(0.0)
    points = VectorAssembler(inputCols=pathways, outputCol="features").transform(wide)
    z = PCA(k=k, inputCol="features", outputCol="z").fit(points).transform(points)
    long = z.select("sample_id", F.posexplode(vector_to_array("z")).alias("j", "score"))
    return long.select("sample_id", F.concat(F.lit("C"), F.col("j")).alias("pathway"), "score")


def _k(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "embeddings").agg(F.count_distinct("label")).first()[0]


@query("gmm_embeddings_large")
def gmm_assign_large(spark, sf):
    scores = reduced_large(vectors(spark, sf), [f"D{j:02d}" for j in range(64)])
    return CL.assign_large(scores, [f"C{j}" for j in range(8)], _k(spark, sf))


def _cohort(spark, n=120, seed=42):
    c = S.cohort(spark, n_samples=n, n_pathways=6, genes_per_pathway=8, effect=2.0, noise=0.5, seed=seed)
    scores = B.zscores(B.pathway_scores(c.burden, c.membership, c.truth))
    return c, scores


def _draw(seed: str, *ids: str) -> str:
    """The simulators' arithmetic in SQL: in (0, 1) from whole numbers."""
    h = f"{seed}::BIGINT"
    for x in ids:
        a = f"(({x} % 2147483647) * 1103515245 + ({h}) * 40503 + 42) % 2147483647"
        h = f"list_reduce([({h}), {a}], lambda t, a: (a * 48271 + (a % 65537) * (t + 1)) % 2147483647)"
        for _ in range(2):
            h = f"list_reduce([0::BIGINT, {h}], lambda z, h: (h * h + h * 69621 + 7) % 2147483647)"
    return f"(({h}) + 0.5) / 2147483647.0::DOUBLE"


def _normal(seed: int, *ids: str) -> str:
    return f"sqrt(-2 * ln({_draw(str(seed), *ids)})) * cos(2 * pi() * {_draw(str(seed + 1), *ids)})"


def _truth_sql(n: int, k: int, seed: int) -> str:
    edges = " ".join(f"WHEN share < {(i + 1) / k!r} THEN {i}" for i in range(k - 1))
    return f"""SELECT s, CASE {edges} ELSE {k - 1} END AS truth FROM (SELECT s, (percent_rank() OVER (ORDER BY {_draw(str(seed), "s")}) * ({n} - 1) + 0.5) / {n} AS share FROM range(0, {n}) t(s))"""


def _cohort_sql(n: int, d: int, genes: int, k: int, effect: float, noise: float, seed: int) -> str:
    """truth, members and burden of a simulated cohort."""
    return f"""truth AS MATERIALIZED ({_truth_sql(n, k, seed)}),
 members AS MATERIALIZED (SELECT p, g FROM (SELECT p, greatest(5, round({genes} + 5 * {_normal(seed + 2, "p")}))::INT AS n FROM range(0, {d}) t(p)), range(1, 100) u(g) WHERE g <= n),
 burden AS MATERIALIZED (SELECT s, p, g, truth, greatest(0, -0.5 * ln({_draw(str(seed + 3), "s", "p", "g")}) + CASE WHEN p % {k} = truth THEN {effect * noise} + 0.1 * {_normal(seed + 4, "s", "p", "g")} ELSE 0 END
 + {noise * 0.1} * {_normal(seed + 6, "s", "p", "g")}) AS burden FROM truth, members)"""


@query(
    "simulated_scores",
    f"""WITH {_cohort_sql(120, 6, 8, 3, 2.0, 0.5, 42)}, m AS (SELECT s, p, avg(burden) AS score FROM burden GROUP BY 1, 2)
 SELECT 'S' || lpad(s::VARCHAR, 5, '0') AS sample_id, 'PATHWAY_' || lpad(p::VARCHAR, 2, '0') AS pathway, round((score - avg(score) OVER w) / stddev_samp(score) OVER w, 6) AS score FROM m WINDOW w AS (PARTITION BY p)""",
)
def simulated_scores(spark, sf):
    return A.rounded(_cohort(spark)[1], "score")


@query(
    "simulated_ancestry",
    f"""WITH truth AS (SELECT *, CASE WHEN {_draw("50", "s")} < 0.6 THEN truth % 2 ELSE floor({_draw("51", "s")} * 2)::INT END AS ancestry FROM ({_truth_sql(90, 3, 42)}))
 SELECT 'S' || lpad(s::VARCHAR, 5, '0') AS sample_id, truth::INT AS truth, ancestry::INT AS ancestry FROM truth""",
)
def simulated_ancestry(spark, sf):
    c = S.cohort(spark, 90, 6, 8, effect=2.0, n_ancestry=2, ancestry_effect=0.5, confounding=0.6)
    return c.truth.select("sample_id", F.col("truth").cast("int").alias("truth"), F.col("ancestry").cast("int").alias("ancestry"))


@query(
    "simulated_expression",
    f"""WITH truth AS MATERIALIZED ({_truth_sql(60, 3, 42)}), v AS (SELECT s, g, {_draw("47", "s", "g")} AS out, 6.0 + 2.0 * {_normal(44, "g")} + CASE WHEN g // 6 < 5 AND (g // 6) % 3 = truth THEN 1.5 ELSE 0 END + 0.3 * {_normal(45, "s", "g")} AS v
 FROM truth, range(0, 40) t(g))
 SELECT 'S' || lpad(s::VARCHAR, 5, '0') AS sample_id, 'GENE' || g AS gene, round(CASE WHEN out < 0.05 THEN 0 ELSE greatest(0, v) END, 6) AS value FROM v""",
)
def simulated_expression(spark, sf):
    found = S.expression_cohort(spark, 60, 40, 5, 6, effect=1.5)
    return A.rounded(found[0], "value")


@query(
    "simulated_cohort_pair",
    f"""WITH {_cohort_sql(50, 5, 8, 3, 1.5, 0.5, 7)}, b AS (WITH {_cohort_sql(40, 5, 8, 3, 1.5, 0.5, 1007)} SELECT * FROM burden), e AS (SELECT 'a' AS cohort, * FROM burden UNION ALL SELECT 'b', * FROM b)
 SELECT cohort, truth::INT AS truth, count(DISTINCT s) AS samples, count(*) AS cells, round(sum(burden), 4) AS burden FROM e GROUP BY 1, 2""",
)
def simulated_cohort_pair(spark, sf):
    """Two cohorts of the same subtypes with draws of their own: sizes and sums."""
    pair = S.cohort_pair(spark, 50, 40, 7, n_pathways=5, genes_per_pathway=8, effect=1.5, noise=0.5)
    rows = None
    for name, c in zip("ab", pair, strict=True):
        own = c.burden.join(c.truth, "sample_id").select(F.lit(name).alias("cohort"), F.col("truth").cast("int").alias("truth"), "sample_id", "burden")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("cohort", "truth").agg(
        F.count_distinct("sample_id").alias("samples"), F.count(F.lit(1)).alias("cells"), F.round(F.sum("burden"), 4).alias("burden")
    )


@query(
    "ancestry_components",
    """WITH g AS (SELECT l_suppkey AS s, l_partkey AS v, least(2, count(*)) AS x FROM lineitem GROUP BY 1, 2), n AS (SELECT count(DISTINCT s)::DOUBLE AS n FROM g),
 m AS (SELECT v, sum(x) / any_value(n) AS mu, sum(x * x) / any_value(n) - (sum(x) / any_value(n)) ^ 2 AS vr FROM g, n GROUP BY 1 HAVING vr > 1e-12)
 SELECT a.i AS a, b.i AS b, CASE WHEN a.i = b.i THEN round((SELECT count(*) FROM m) * any_value(n.n), 3) END AS total, 0.0::DOUBLE AS product FROM range(1, 6) a(i), range(1, 6) b(i), n WHERE a.i <= b.i GROUP BY 1, 2""",
)
def ancestry_components(spark, sf):
    """What the first five components have to be: without correlation, each with its share of the whole variance, which
    is the number of samples times that of variants that differ."""
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("variant_id"))
    dosages = lines.groupBy("sample_id", "variant_id").agg(F.least(F.lit(2), F.count(F.lit(1))).cast("int").alias("dosage"))
    found = ensure_cut(CL.ancestry_components(dosages, dosages.select("sample_id"), 5)).withColumn("i", F.substring("pc", 3, 1).cast("long"))
    a, b = found.alias("a"), found.alias("b")
    pairs = a.join(b, (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.i") <= F.col("b.i")))
    product = pairs.groupBy(F.col("a.i").alias("a"), F.col("b.i").alias("b")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("p"), F.first("a.ratio").alias("ratio"))
    same = F.col("a") == F.col("b")
    return product.select("a", "b", F.when(same, F.round(F.col("p") / F.col("ratio"), 3)).alias("total"), F.when(same, 0.0).otherwise(F.abs(F.round("p", 4))).alias("product"))


@query(
    "ancestry_regress_out",
    with_tables(
        "scores",
        """, j AS (SELECT sample_id, pathway, score AS y, c_acctbal AS x1, c_nationkey::DOUBLE AS x2 FROM scores JOIN customer ON c_custkey = sample_id),
 s AS (SELECT pathway, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(y) AS vy FROM j GROUP BY 1),
 f AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s),
 e AS (SELECT sample_id, pathway, vy, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS res FROM j JOIN f USING (pathway))
 SELECT sample_id, pathway, round((res - avg(res) OVER p) / stddev_samp(res) OVER p, 5) AS score, round(greatest(0, 1 - var_pop(res) OVER p / vy), 6) AS r2, greatest(0, 1 - var_pop(res) OVER p / vy) > 0.1 AS confounded FROM e WINDOW p AS (PARTITION BY pathway)""",
    ),
)
def ancestry_regress_out(spark, sf):
    c = table(spark, sf, "customer")
    one = c.select(F.col("c_custkey").alias("sample_id"), F.lit("PC1").alias("pc"), F.col("c_acctbal").alias("value"))
    pcs = one.union(c.select("c_custkey", F.lit("PC2"), F.col("c_nationkey").cast("double")))
    found = CL.regress_out(A.scores(spark, sf), pcs)
    return found.withColumn("score", F.round("score", 5)).withColumn("r2", F.round("r2", 6))


#: Of five groups, so that the tail of the statistic has a closed form.
KW5 = """, s AS (SELECT pathway, grp, sum(rank) AS r, count(*) AS n FROM r GROUP BY 1, 2), tt AS (SELECT pathway, sum(t::DOUBLE * t - 1) AS tie, count(*)::DOUBLE AS n FROM r GROUP BY 1),
 kw AS (SELECT pathway, (12 / (any_value(tt.n) * (any_value(tt.n) + 1)) * sum(r * r / s.n) - 3 * (any_value(tt.n) + 1)) / (1 - any_value(tie) / (any_value(tt.n) ^ 3 - any_value(tt.n))) AS h FROM s JOIN tt USING (pathway) GROUP BY 1)"""


@query(
    "ancestry_independence",
    """WITH r AS (SELECT 'PC1' AS pathway, c_mktsegment AS grp, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0::DOUBLE AS rank, count(*) OVER (PARTITION BY c_acctbal) AS t FROM customer)"""
    + KW5
    + " SELECT pathway AS pc, round(h, 6) AS h, round(exp(-h / 2) * (1 + h / 2), 6) AS p FROM kw",
)
def ancestry_independence(spark, sf):
    c = table(spark, sf, "customer")
    pcs = c.select(F.col("c_custkey").alias("sample_id"), F.lit("PC1").alias("pc"), F.col("c_acctbal").alias("value"))
    found = CL.independence(c.select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("cluster")), pcs)
    return A.rounded(found, "h", "p")


@query(
    "batch_effects",
    with_tables(
        "batched",
        ANOVA.format(by="batch", t="batched")
        + """, f AS (SELECT pathway, (ssb / (k - 1)) / (ssw / (n - k)) AS f, ssb / (ssb + ssw) AS eta2, (n - k) / 2.0::DOUBLE AS h, ssw / (ssw + ssb) AS x FROM a)
 SELECT pathway, round(f, 6) AS f_stat, round(eta2, 6) AS eta2, round(x ^ h * (1 + h * (1 - x)), 6) AS p FROM f""",
    ),
)
def batch_effects(spark, sf):
    """Five batches, so that the tail of F has a closed form."""
    return A.rounded(CO.batch_effects(A.batched(spark, sf)).select("pathway", "f_stat", "eta2", "p"), "f_stat", "eta2", "p")


@query(
    "enrichment_tests",
    with_tables(
        "labelled",
        KW + BH + """, q AS (SELECT pathway, p, least(1, min(raw) OVER (ORDER BY p DESC, pathway DESC ROWS UNBOUNDED PRECEDING)) AS q FROM o)"""
        + REST + """ SELECT pathway, grp, round(effect_size, 6) AS effect_size, round(p, 6) AS p, round(q, 6) AS q, q < 0.05 AS significant FROM d JOIN q USING (pathway)""",
    ),
)
def enrichment_tests(spark, sf):
    exact = A.labelled(spark, sf).withColumn("score", F.round("score", 9))
    found = CH.enrichment(exact).select("pathway", "grp", "effect_size", "p", "q", "significant")
    return A.rounded(found, "effect_size", "p", "q")


@query("stream_burden_equals_batch", with_tables("burden", "SELECT sample_id, gene, round(burden, 6) AS burden FROM burden"))
def stream_burden_equals_batch(spark, sf):
    """The burden of all purchases read as a stream of files."""
    from ..streaming.burden import run_once

    path = f"{sf}/lineitem.parquet"
    schema = spark.read.parquet(path).schema
    lines = spark.readStream.schema(schema).parquet(path) if _is_dir(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("sample_id"))
    carried = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("sample_id", F.col("l_partkey").alias("variant_id"))
    # Dosages are at most 2 for a sample and variant: counted in the stream, capped and weighted on what it gives.
    counts = carried.groupBy("sample_id", "variant_id").count()
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    found = run_once(counts, ["sample_id", "variant_id"], folder)
    dosages = found.select("sample_id", "variant_id", F.least(F.lit(2), F.col("count")).cast("int").alias("dosage"))
    return A.rounded(B.gene_burden(A.variants(spark, sf), dosages), "burden")


@query("stream_keyed_burden", with_tables("burden", "SELECT sample_id, gene, round(burden, 6) AS burden FROM burden"))
def stream_keyed_burden(spark, sf):
    """All purchases as a stream of observations in which every file comes twice: capping and weighting are in the state."""
    from ..functions.weights import pipeline_weight
    from ..streaming.keyed import run_capped

    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("sample_id"))
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey")  # numbers of lines repeat within an order
    event = F.concat_ws("-", "l_orderkey", "l_linenumber", F.row_number().over(one))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey")  # for the window and the join
    lines = lines.select("l_orderkey", F.col("l_partkey").alias("variant_id"), event.alias("event"))
    weighted = A.variants(spark, sf).select("variant_id", "gene", pipeline_weight(F.col("consequence"), F.col("cadd")).alias("weight"))
    seen = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(weighted, "variant_id").select("sample_id", "gene", "variant_id", "event", "weight")
    folder = f"{ensure_checkpoint_dir(spark)}/keyed-{uuid.uuid4().hex}"
    # Four thirds of the files of a copy at a time, so that a batch holds some of them twice and the next one the rest.
    share = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    seen.repartition(3 * share, "event").write.parquet(f"{folder}/in")
    spark.read.schema(seen.schema).parquet(f"{folder}/in").repartition(3 * share, "event").write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 4 * share).parquet(f"{folder}/in")
    return A.rounded(run_capped(stream, folder), "burden")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("benchmark_sweep")
def benchmark_sweep(spark, sf):
    return bundles.sweep_summary(bundles.benchmark_sweep(spark, (1.0, 2.0), (60,), 6))


@query("reference_validation")
def reference_validation(spark, sf):
    """Gene sets against a reference made of the parts: symbols with a number of pathogenic variants."""
    hit = F.count_if((F.col("p_type") == "PROMO") & (F.col("p_size") > 40))
    summary = table(spark, sf, "part").groupBy(F.col("p_brand").alias("symbol")).agg(hit.alias("n_pathogenic"))
    sets = A.membership(spark).where("pathway like 'mod5%'")
    found = bundles.full_validation(spark, sets, summary, A.membership(spark).where("pathway like 'mod3%'"), 60, 3, 2.0)
    return found["plausibility"].withColumn("synthetic_ari", F.lit(found["synthetic_ari"])).withColumn("passed", F.lit(found["passed"]))
