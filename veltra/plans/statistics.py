"""Queries on expression scores, normalisation, batch correction, tests, agreement and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf_even
from ..operators import agreement as AG
from ..operators import bundles
from ..operators import burden as B
from ..operators import correction as C
from ..operators import crossref as X
from ..operators import expression as E
from ..operators import inference as I
from ..operators import resample as R
from ..session import table
from . import analogue as A
from .analogue import rounded, with_tables
from .registry import ORACLES, query

RANKED = """, r AS (SELECT sample_id, gene, value, rank() OVER w + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0::DOUBLE AS rank,
 count(*) OVER (PARTITION BY sample_id) AS n FROM expression WINDOW w AS (PARTITION BY sample_id ORDER BY value))"""
ECDF = """, e AS (SELECT sample_id, gene, (rank() OVER w + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY gene) AS ecdf
 FROM expression WINDOW w AS (PARTITION BY gene ORDER BY value))"""


@query("avg_rank", with_tables("expression", RANKED + " SELECT sample_id, gene, rank::DOUBLE AS rank FROM r"))
def avg_rank(spark: SparkSession, sf: str) -> DataFrame:
    return B.average_ranks(A.expression(spark, sf), ["sample_id"], "value").select("sample_id", "gene", "rank")


@query("ecdf", with_tables("expression", ECDF + " SELECT sample_id, gene, round(ecdf, 6) AS ecdf FROM e"))
def ecdf(spark, sf):
    out = B.average_ranks(A.expression(spark, sf), ["gene"], "value")
    return out.select("sample_id", "gene", F.round(F.col("rank") / F.col("n"), 6).alias("ecdf"))


@query(
    "mean_z",
    with_tables(
        "sets",
        """, z AS (SELECT sample_id, gene, (value - avg(value) OVER g) / stddev_samp(value) OVER g AS z FROM expression WINDOW g AS (PARTITION BY gene))
 SELECT sample_id, pathway, round(avg(z), 6) AS score FROM z JOIN sets USING (gene) GROUP BY 1, 2""",
    ),
)
def mean_z(spark, sf):
    return rounded(E.mean_z(A.expression(spark, sf), A.membership(spark)), "score")


@query(
    "ssgsea",
    with_tables(
        "sets",
        RANKED
        + """, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rank DESC, gene) AS pos FROM r),
 h AS (SELECT o.sample_id, p.pathway, o.pos, o.n, p.size, CASE WHEN s.gene IS NULL THEN 0 ELSE rank ^ 0.25 END AS w, (s.gene IS NULL)::INT AS miss
 FROM o CROSS JOIN (SELECT DISTINCT pathway, size FROM sets) p LEFT JOIN sets s ON s.pathway = p.pathway AND s.gene = o.gene),
 c AS (SELECT sample_id, pathway, size, n, sum(w) OVER a / nullif(sum(w) OVER (PARTITION BY sample_id, pathway), 0) AS hit, sum(miss) OVER a / nullif(n - size, 0)::DOUBLE AS mis
 FROM h WINDOW a AS (PARTITION BY sample_id, pathway ORDER BY pos ROWS UNBOUNDED PRECEDING))
 SELECT sample_id, pathway, round(coalesce(sum(hit - mis), 0), 6) AS score FROM c GROUP BY 1, 2 HAVING max(hit) > 0""",
    ),
)
def ssgsea(spark, sf):
    return rounded(E.ssgsea(A.expression(spark, sf), A.membership(spark)), "score")


@query(
    "gsva",
    with_tables(
        "sets",
        ECDF
        + """, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ecdf DESC, gene) AS pos, count(*) OVER (PARTITION BY sample_id) AS n FROM e),
 h AS (SELECT o.sample_id, p.pathway, o.pos, o.n, p.size, (s.gene IS NOT NULL)::INT AS hit FROM o CROSS JOIN (SELECT DISTINCT pathway, size FROM sets) p
 LEFT JOIN sets s ON s.pathway = p.pathway AND s.gene = o.gene),
 c AS (SELECT sample_id, pathway, sum(hit) OVER a / size::DOUBLE - sum(1 - hit) OVER a / (n - size)::DOUBLE AS d FROM h WINDOW a AS (PARTITION BY sample_id, pathway ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT sample_id, pathway, max(d) AS hi, min(d) AS lo FROM c GROUP BY 1, 2)
 SELECT sample_id, pathway, round(CASE WHEN round(hi, 9) >= round(-lo, 9) THEN hi ELSE lo END, 6) AS score FROM m""",
    ),
)
def gsva(spark, sf):
    return rounded(E.gsva(A.expression(spark, sf), A.membership(spark)), "score")


@query(
    "expr_filters",
    """SELECT l_suppkey AS gene, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_tax <> 0) >= 3 AND var_samp(l_tax) > 0""",
)
def expr_filters(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_orderkey").alias("sample_id"), F.col("l_tax").alias("value"))
    return E.filter_genes(rows).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query(
    "log2_transform",
    with_tables("expression", "SELECT sample_id, gene, round(CASE WHEN (SELECT max(value) FROM expression) > 20 THEN log2(value + 1) ELSE value END, 6) AS value FROM expression"),
)
def log2_transform(spark, sf):
    return rounded(E.transform(A.expression(spark, sf)), "value")


def _norm(name: str, sql: str) -> None:
    @query(f"norm_{name}", with_tables("scores", sql))
    def run(spark, sf):
        exact = A.scores(spark, sf)
        if name == "rank":  # equal scores must be equal whatever the order of their sums
            exact = exact.withColumn("score", F.round("score", 9))
        return B.normalise(exact, name).withColumn("score", F.round("score", 6) + 0)  # no negative zero


_norm(
    "minmax",
    """SELECT sample_id, pathway, round((score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p), 6) AS score FROM scores WINDOW p AS (PARTITION BY pathway)""",
)
_norm(
    "robust",
    """, q AS (SELECT pathway, quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.75) AS c FROM scores GROUP BY 1)
 SELECT sample_id, pathway, round(CASE WHEN c > a THEN (score - b) / (c - a) ELSE score END, 6) + 0 AS score FROM scores JOIN q USING (pathway)""",
)
_norm(
    "rank",
    """, s AS (SELECT sample_id, pathway, round(score, 9) AS score FROM scores)
 SELECT sample_id, pathway, round((rank() OVER w + (count(*) OVER (PARTITION BY pathway, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY pathway), 6) AS score
 FROM s WINDOW w AS (PARTITION BY pathway ORDER BY score)""",
)


def _labelled9(spark, sf):
    return A.labelled(spark, sf).withColumn("score", F.round("score", 9))


ANOVA = """, g AS (SELECT pathway, {by}, count(*) AS n, avg(score) AS m, var_samp(score) * (count(*) - 1) AS ss FROM {t} GROUP BY 1, 2),
 a AS (SELECT pathway, count(*) AS k, sum(n)::BIGINT AS n, sum(ss) AS ssw, sum(n * (m - (SELECT avg(score) FROM {t} x WHERE x.pathway = g.pathway)) ^ 2) AS ssb FROM g GROUP BY 1)"""


@query(
    "anova_f",
    with_tables("labelled", ANOVA.format(by="grp", t="labelled") + " SELECT pathway, k, n, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f_stat, round(ssb / (ssb + ssw), 6) AS eta2 FROM a"),
)
def anova_f(spark, sf):
    return rounded(I.anova(A.labelled(spark, sf)), "f_stat", "eta2")


@query("batch_eta2", with_tables("batched", ANOVA.format(by="batch", t="batched") + " SELECT pathway, round(ssb / (ssb + ssw), 6) AS eta2 FROM a"))
def batch_eta2(spark, sf):
    return rounded(I.anova(A.batched(spark, sf).withColumnRenamed("batch", "grp")).select("pathway", "eta2"), "eta2")


@query(
    "batch_mean_center",
    with_tables("batched", "SELECT sample_id, batch, pathway, round(score - avg(score) OVER (PARTITION BY pathway, batch) + avg(score) OVER (PARTITION BY pathway), 6) AS score FROM batched"),
)
def batch_mean_center(spark, sf):
    return rounded(C.mean_center(A.batched(spark, sf)), "score")


@query(
    "batch_standardize",
    with_tables(
        "batched",
        """SELECT sample_id, batch, pathway, round((score - avg(score) OVER b) / stddev_samp(score) OVER b * stddev_samp(score) OVER p + avg(score) OVER p, 6) AS score
 FROM batched WINDOW b AS (PARTITION BY pathway, batch), p AS (PARTITION BY pathway)""",
    ),
)
def batch_standardize(spark, sf):
    return rounded(C.standardize(A.batched(spark, sf)), "score")


COMBAT = """, w AS (SELECT pathway, avg(score) AS grand, stddev_samp(score) AS sd FROM batched GROUP BY 1),
 z AS (SELECT sample_id, batch, pathway, grand, sd, (score - grand) / sd AS z FROM batched JOIN w USING (pathway)),
 g AS (SELECT pathway, batch, count(*) AS n, avg(z) AS gam, var_samp(z) AS del FROM z GROUP BY 1, 2),
 t AS (SELECT *, avg(gam) OVER p AS gbar, var_samp(gam) OVER p AS tau2, avg(del) OVER p AS dbar FROM g WINDOW p AS (PARTITION BY pathway)),
 s AS (SELECT pathway, batch, tau2 / (tau2 + del / n) AS wt, gam, gbar, sqrt((1 - least(0.5, 2.0 / n)) * del + least(0.5, 2.0 / n) * dbar) AS root FROM t),
 combat AS (SELECT sample_id, batch, pathway, (z - (wt * gam + (1 - wt) * gbar)) / root * sd + grand AS score FROM z JOIN s USING (pathway, batch))"""


@query("combat", with_tables("batched", COMBAT + " SELECT sample_id, batch, pathway, round(score, 6) AS score FROM combat"))
def combat(spark, sf):
    return rounded(C.combat(A.batched(spark, sf)), "score")


@query(
    "batch_validate",
    with_tables(
        "batched",
        COMBAT
        + ANOVA.format(by="batch", t="batched")
        + ANOVA.format(by="batch", t="combat").replace(" g AS", " g2 AS").replace("FROM g ", "FROM g2 ").replace("g.pathway", "g2.pathway").replace(" a AS", " a2 AS")
        + """, r AS (SELECT b.pathway, corr(b.score, c.score) AS r FROM batched b JOIN combat c USING (sample_id, pathway) GROUP BY 1)
 SELECT pathway, round(a.ssb / (a.ssb + a.ssw), 6) AS eta2_before, round(a2.ssb / (a2.ssb + a2.ssw), 6) AS eta2_after, round(r, 6) AS r FROM a JOIN a2 USING (pathway) JOIN r USING (pathway)""",
    ).replace("), g AS (SELECT pathway, batch, count(*) AS n, avg(score)", "), gg AS (SELECT pathway, batch, count(*) AS n, avg(score)", 1)
    .replace("AS ssb FROM g GROUP", "AS ssb FROM gg AS g GROUP", 1),
)
def batch_validate(spark, sf):
    b = A.batched(spark, sf)
    return rounded(C.validate(b, C.combat(b)), "eta2_before", "eta2_after", "r")


@query(
    "max_pairwise_d",
    with_tables(
        "labelled",
        """, g AS (SELECT pathway, grp, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM labelled GROUP BY 1, 2)
 SELECT a.pathway, round(max(abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))), 6) AS effect_size FROM g a JOIN g b ON a.pathway = b.pathway AND a.grp < b.grp GROUP BY 1""",
    ),
)
def max_pairwise_d(spark, sf):
    return rounded(I.max_pairwise_d(A.labelled(spark, sf)), "effect_size")


KW = """, l9 AS (SELECT sample_id, grp, pathway, round(score, 9) AS score FROM labelled),
 r AS (SELECT pathway, grp, rank() OVER w + (count(*) OVER (PARTITION BY pathway, score) - 1) / 2.0::DOUBLE AS rank, count(*) OVER (PARTITION BY pathway, score) AS t FROM l9 WINDOW w AS (PARTITION BY pathway ORDER BY score)),
 s AS (SELECT pathway, grp, sum(rank) AS r, count(*) AS n FROM r GROUP BY 1, 2), tt AS (SELECT pathway, sum(t::DOUBLE * t - 1) AS tie, count(*)::DOUBLE AS n FROM r GROUP BY 1),
 kw AS (SELECT pathway, (12 / (any_value(tt.n) * (any_value(tt.n) + 1)) * sum(r * r / s.n) - 3 * (any_value(tt.n) + 1)) / (1 - any_value(tie) / (any_value(tt.n) ^ 3 - any_value(tt.n))) AS h, count(*) - 1 AS df FROM s JOIN tt USING (pathway) GROUP BY 1)"""


def _kw(spark, sf):
    h = I.kruskal_wallis(_labelled9(spark, sf))
    return h.withColumn("p", chi2_sf_even(F.col("h"), 2))


@query("kruskal_wallis", with_tables("labelled", KW + " SELECT pathway, round(h, 6) AS h, df, round(exp(-h / 2), 6) AS p FROM kw"))
def kruskal_wallis(spark, sf):
    return rounded(_kw(spark, sf), "h", "p")


BH = """, p AS (SELECT pathway, exp(-h / 2) AS p FROM kw), o AS (SELECT pathway, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, pathway) AS raw FROM p)"""


@query("bh_qvalues", with_tables("labelled", KW + BH + " SELECT pathway, round(p, 6) AS p, round(least(1, min(raw) OVER (ORDER BY p DESC, pathway DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM o"))
def bh_qvalues(spark, sf):
    return rounded(I.benjamini_hochberg(_kw(spark, sf).select("pathway", "p")), "p", "q")


@query("bh_nonmonotone", with_tables("labelled", KW + BH + " SELECT pathway, round(p, 6) AS p, round(least(1, raw), 6) AS q FROM o"))
def bh_nonmonotone(spark, sf):
    return rounded(I.benjamini_hochberg(_kw(spark, sf).select("pathway", "p"), monotone=False), "p", "q")


REST = """, g AS (SELECT a.pathway, a.grp, count(*) FILTER (b.grp = a.grp) AS n1, avg(b.score) FILTER (b.grp = a.grp) AS m1, var_samp(b.score) FILTER (b.grp = a.grp) AS v1,
 count(*) FILTER (b.grp <> a.grp) AS n2, avg(b.score) FILTER (b.grp <> a.grp) AS m2, var_samp(b.score) FILTER (b.grp <> a.grp) AS v2, avg(b.score) AS m
 FROM (SELECT DISTINCT pathway, grp FROM labelled) a JOIN labelled b USING (pathway) GROUP BY 1, 2),
 d AS (SELECT pathway, grp, n1 AS n, m1 AS mean, m AS overall, m1 / m AS fold, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS effect_size FROM g)"""


@query(
    "enrichment",
    with_tables(
        "labelled",
        REST
        + """ SELECT pathway, grp, n, round(mean, 9) AS mean, round(overall, 9) AS overall, round(fold, 6) AS fold, round(effect_size, 6) AS effect_size,
 (row_number() OVER (PARTITION BY grp ORDER BY round(abs(effect_size), 9) DESC, pathway))::INT AS place FROM d""",
    ),
)
def enrichment(spark, sf):
    from ..operators.characterize import enrichment_order

    out = enrichment_order(I.one_against_rest(A.labelled(spark, sf))).withColumns({c: F.round(c, 9) for c in ("mean", "overall")})
    return rounded(out, "fold", "effect_size")


@query(
    "gene_contributions_topn",
    with_tables(
        "burden samples",
        """, labelled AS (SELECT s.sample_id, g.gene AS pathway, coalesce(b.burden, 0) AS score, 'g' || (s.sample_id % 3) AS grp FROM samples s CROSS JOIN (SELECT DISTINCT gene FROM burden) g LEFT JOIN burden b ON b.sample_id = s.sample_id AND b.gene = g.gene)"""
        + REST
        + """ SELECT grp, pathway AS gene, round(mean, 9) AS mean, round(effect_size, 6) AS effect_size, (row_number() OVER (PARTITION BY grp ORDER BY round(abs(effect_size), 9) DESC, pathway))::INT AS place FROM d QUALIFY place <= 5""",
    ),
)
def gene_contributions_topn(spark, sf):
    from ..operators.characterize import gene_contributions

    top = gene_contributions(A.burden(spark, sf), A.groups(spark, sf), top_n=5)
    return rounded(top.select("grp", "gene", F.round("mean", 9).alias("mean"), "effect_size", "place"), "effect_size")


PCS = """, pcs AS (SELECT c_custkey AS sample_id, 'PC1' AS pc, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'PC2', c_nationkey::DOUBLE FROM customer)"""


def _pcs(spark, sf):
    c = table(spark, sf, "customer")
    one = c.select(F.col("c_custkey").alias("sample_id"), F.lit("PC1").alias("pc"), F.col("c_acctbal").alias("value"))
    return one.union(c.select("c_custkey", F.lit("PC2"), F.col("c_nationkey").cast("double")))


@query("pearson_matrix", with_tables("scores", PCS + " SELECT pathway, pc, round(corr(score, value), 6) AS r FROM scores JOIN pcs USING (sample_id) GROUP BY 1, 2"))
def pearson_matrix(spark, sf):
    return rounded(I.pearson_matrix(A.scores(spark, sf), _pcs(spark, sf)), "r")


@query(
    "regress_out_1pc",
    with_tables(
        "scores",
        """, j AS (SELECT sample_id, pathway, score, c_acctbal AS x FROM scores JOIN customer ON c_custkey = sample_id),
 f AS (SELECT pathway, regr_slope(score, x) AS b, regr_intercept(score, x) AS a, regr_r2(score, x) AS r2 FROM j GROUP BY 1),
 e AS (SELECT sample_id, pathway, score - a - b * x AS res, r2 FROM j JOIN f USING (pathway))
 SELECT sample_id, pathway, round((res - avg(res) OVER p) / stddev_samp(res) OVER p, 6) AS score, round(r2, 6) AS r2 FROM e WINDOW p AS (PARTITION BY pathway)""",
    ),
)
def regress_out_1pc(spark, sf):
    return rounded(I.regress_out_one(A.scores(spark, sf), A.covariate(spark, sf)), "score", "r2")


LABELS = """, t AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2)""".lstrip(", ")


def _labels(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))


@query("contingency", "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def contingency(spark, sf):
    return AG.contingency(_labels(spark, sf))


@query(
    "ari",
    f"""WITH {LABELS}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS r,
 (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS c, (SELECT sum(n) FROM t) AS n)
 SELECT round((x - r * c / (n * (n - 1) / 2)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2)), 6) AS ari FROM s""",
)
def ari(spark, sf):
    return rounded(AG.adjusted_rand(_labels(spark, sf)), "ari")


@query(
    "nmi",
    f"""WITH {LABELS}, n AS (SELECT sum(n) AS n FROM t), h AS (SELECT -sum(t.n / n.n * ln(t.n / n.n)) AS h FROM t, n),
 ha AS (SELECT -sum(m / n * ln(m / n)) AS h FROM (SELECT sum(n) AS m FROM t GROUP BY a), n), hb AS (SELECT -sum(m / n * ln(m / n)) AS h FROM (SELECT sum(n) AS m FROM t GROUP BY b), n)
 SELECT round((ha.h + hb.h - h.h) / ((ha.h + hb.h) / 2), 6) AS nmi FROM h, ha, hb""",
)
def nmi(spark, sf):
    return rounded(AG.normalized_mutual_information(_labels(spark, sf)), "nmi")


D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
CENTRES = """, u AS (SELECT id, label, unnest(features) AS x, generate_subscripts(features, 1) AS i FROM points),
 cm AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM u GROUP BY 1, 2), c AS (SELECT label, any_value(n) AS n, list(m ORDER BY i) AS c FROM cm GROUP BY 1)"""


@query(
    "nearest_centroid",
    with_tables("points", CENTRES + f""", d AS (SELECT p.id, c.label, {D2.format(a="p.features", b="c.c")} AS d2 FROM points p CROSS JOIN c)
 SELECT id, first(label ORDER BY round(d2, 9), label) AS label, round(sqrt(min(d2)), 6) AS distance FROM d GROUP BY 1"""),
)
def nearest_centroid(spark, sf):
    p = A.points(spark, sf)
    return rounded(AG.nearest_centroid(p.select("id", "features"), AG.centroids(p)), "distance")


@query(
    "cluster_quality",
    with_tables(
        "points",
        CENTRES
        + f""", gm AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x) AS m FROM u GROUP BY 1)), w AS (SELECT p.label, sum({D2.format(a="p.features", b="c.c")}) AS ssw, avg(sqrt({D2.format(a="p.features", b="c.c")})) AS s FROM points p JOIN c USING (label) GROUP BY 1),
 k AS (SELECT label, n, c, ssw, s FROM c JOIN w USING (label)), db AS (SELECT a.label, max((a.s + b.s) / sqrt({D2.format(a="a.c", b="b.c")})) AS r FROM k a JOIN k b ON a.label <> b.label GROUP BY 1)
 SELECT round((sum(n * {D2.format(a="c", b="g")}) / (count(*) - 1)) / (sum(ssw) / (sum(n) - count(*))), 6) AS calinski_harabasz, round((SELECT avg(r) FROM db), 6) AS davies_bouldin FROM k, gm""",
    ),
)
def cluster_quality(spark, sf):
    return rounded(AG.cluster_quality(A.points(spark, sf)), "calinski_harabasz", "davies_bouldin")


@query(
    "silhouette",
    with_tables(
        "points",
        f""", d AS (SELECT a.id, a.label, b.label AS l, sqrt({D2.format(a="a.features", b="b.features")}) AS d FROM points a CROSS JOIN points b),
 s AS (SELECT id, label, l, sum(d) AS s, count(*) AS n FROM d GROUP BY 1, 2, 3),
 ab AS (SELECT id, max(CASE WHEN l = label THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN l <> label THEN s / n END) AS b FROM s GROUP BY 1)
 SELECT id, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM ab""",
    ),
)
def silhouette(spark, sf):
    return rounded(AG.silhouette(A.points(spark, sf)), "silhouette")


SETS = """s AS (SELECT DISTINCT 'S' || l_suppkey AS pathway, p_brand || p_type AS gene FROM lineitem JOIN part ON l_partkey = p_partkey),
 m AS (SELECT DISTINCT 'M' || c_mktsegment || '_' || c_nationkey AS pathway, p_brand || p_type AS gene FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def _sets(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")  # noqa: E741
    p, o, c = (table(spark, sf, t) for t in ("part", "orders", "customer"))
    lp = l.join(p, l.l_partkey == p.p_partkey)
    gene = F.concat("p_brand", "p_type").alias("gene")
    own = lp.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("pathway"), gene)
    market = lp.join(o, lp.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    name = F.concat(F.lit("M"), "c_mktsegment", F.lit("_"), F.col("c_nationkey").cast("string"))
    return own.distinct(), market.select(name.alias("pathway"), gene).distinct()


@query(
    "jaccard_best_match",
    f"""WITH {SETS}, x AS (SELECT s.pathway, m.pathway AS match, count(*) AS c FROM s JOIN m USING (gene) GROUP BY 1, 2),
 j AS (SELECT x.pathway, match, c / ((SELECT count(*) FROM s WHERE s.pathway = x.pathway) + (SELECT count(*) FROM m WHERE m.pathway = x.match) - c)::DOUBLE AS j FROM x)
 SELECT pathway, first(match ORDER BY j DESC, match) AS match, round(max(j), 6) AS jaccard FROM j GROUP BY 1""",
)
def jaccard_best_match(spark, sf):
    return rounded(X.best_jaccard(*_sets(spark, sf)), "jaccard")


@query(
    "coverage_report",
    with_tables(
        "membership variants",
        """, m AS (SELECT DISTINCT pathway, gene FROM membership), j AS (SELECT pathway, count(*) AS n, count(*) FILTER (gene IN (SELECT gene FROM variants)) AS k FROM m GROUP BY 1)
 SELECT count(*) FILTER (k >= 2) AS n_covered, count(*) AS n_sets, round(avg(k / n::DOUBLE), 6) AS mean_coverage FROM j""",
    ),
)
def coverage_report(spark, sf):
    return rounded(X.coverage(A.membership(spark), A.variants(spark, sf)), "mean_coverage")


@query(
    "clinvar_coverage",
    with_tables(
        "membership",
        """, c AS (SELECT upper(p_brand) AS gene, count(*) FILTER (p_type = 'PROMO' AND p_size > 47) AS p FROM part GROUP BY 1)
 SELECT pathway, count(*) AS n_genes, count(p) AS in_clinvar, count(*) FILTER (p > 0) AS with_pathogenic, round(count(p) / count(*)::DOUBLE, 6) AS fraction,
 round(count(*) FILTER (p > 0) / count(*)::DOUBLE, 6) AS pathogenic_fraction FROM membership m LEFT JOIN c ON c.gene = upper(m.gene) GROUP BY 1""",
    ),
)
def clinvar_coverage(spark, sf):
    hit = F.count_if((F.col("p_type") == "PROMO") & (F.col("p_size") > 47))
    summary = table(spark, sf, "part").groupBy(F.col("p_brand").alias("symbol")).agg(hit.alias("n_pathogenic"))
    return rounded(X.clinvar_coverage(A.membership(spark), summary), "fraction", "pathogenic_fraction")


_GRID = ", ".join(f"({n}, {k}, {X.NULL_ARI[k][i]}, {X.STABILITY[k][i]})" for k in X.NULL_ARI for i, n in enumerate(X.GRID_SAMPLES))


@query(
    "calib_interpolation",
    f"""WITH g(n, k, a, s) AS (VALUES {_GRID}), p AS (SELECT n.n::INT AS n, k.k::INT AS k FROM range(25, 525, 25) n(n), range(2, 10) k(k)),
 b AS (SELECT p.*, (SELECT max(n) FROM g WHERE g.n <= p.n) AS n0, (SELECT min(n) FROM g WHERE g.n >= p.n) AS n1 FROM p)
 SELECT b.n, b.k, round(x.a + (y.a - x.a) * CASE WHEN n1 > n0 THEN (b.n - n0) / (n1 - n0)::DOUBLE ELSE 0 END, 9)::DOUBLE AS null_ari, round(x.s + (y.s - x.s) * CASE WHEN n1 > n0 THEN (b.n - n0) / (n1 - n0)::DOUBLE ELSE 0 END, 9)::DOUBLE AS stability
 FROM b LEFT JOIN g x ON x.n = n0 AND x.k = b.k AND n1 IS NOT NULL LEFT JOIN g y ON y.n = n1 AND y.k = b.k AND n0 IS NOT NULL""",
)
def calib_interpolation(spark, sf):
    p = spark.range(25, 525, 25).select(F.col("id").cast("int").alias("n"), F.explode(F.sequence(F.lit(2), F.lit(9))).alias("k"))
    out = X.interpolate_thresholds(p, X.threshold_grid(spark))
    return out.withColumns({c: F.round(c, 9) for c in ("null_ari", "stability")})


MIX = "(((({i} * 1103515245 + {t} * 40503 + 42) % 2147483647) * 48271 + ((({i} * 1103515245 + {t} * 40503 + 42) % 2147483647) % 65537) * ({t} + 1)) % 2147483647)"


def _mix(i: str, t: str) -> str:
    return MIX.format(i=f"{i}::BIGINT", t=f"{t}::BIGINT")


@query(
    "permutation_labels",
    with_tables(
        "samples",
        f""", l AS (SELECT sample_id, 'g' || (sample_id % 3) AS grp, it FROM samples, range(1, 6) t(it)), r AS (SELECT *, row_number() OVER (PARTITION BY it ORDER BY sample_id) AS i, row_number() OVER (PARTITION BY it ORDER BY {_mix("sample_id", "it")}, sample_id) AS j FROM l)
 SELECT a.it::INT AS it, a.sample_id, b.grp FROM r a JOIN r b ON a.it = b.it AND a.i = b.j""",
    ),
)
def permutation_labels(spark, sf):
    return R.permuted(A.groups(spark, sf), 5)


def _dealt(n_permutations: int) -> str:
    """(it, sample_id, i, n, x): where each sample's number goes in each iteration, one step for each round."""
    steps = [f", d0 AS (SELECT *, i AS x FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i, count(*) OVER () AS n FROM samples), range(1, {n_permutations + 1}) t(it))"]
    for r in range(R.ROUNDS):
        key = f"(({_mix(_mix(str(r), 'it'), str(r))} % n - x) % n + n) % n"
        bit = _mix("greatest(x, y)", f"(it * 64 + {r})")
        steps.append(f"d{r + 1} AS (SELECT sample_id, i, n, it, CASE WHEN {bit} // 65536 % 2 = 1 THEN y ELSE x END AS x FROM (SELECT *, {key} AS y FROM d{r}))")
    return ",\n".join(steps)


@query(
    "permutation_pvalues",
    with_tables(
        "scores",
        _dealt(1000)
        + f""", l AS (SELECT sample_id, 'g' || (sample_id % 3) AS grp FROM samples), o AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS x FROM l),
 p AS (SELECT it, sample_id, grp FROM d{R.ROUNDS} JOIN o USING (x) UNION ALL SELECT 0, sample_id, grp FROM l),
 g AS (SELECT it, pathway, grp, count(*) AS n, avg(score) AS m, var_samp(score) * (count(*) - 1) AS ss FROM p JOIN scores USING (sample_id) GROUP BY 1, 2, 3),
 a AS (SELECT pathway, avg(score) AS mu FROM scores GROUP BY 1),
 f AS (SELECT it, pathway, (sum(n * (m - mu) ^ 2) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f FROM g JOIN a USING (pathway) GROUP BY 1, 2)
 SELECT a.pathway, round(a.f, 6) AS f_stat, (1 + count(*) FILTER (b.f >= a.f - a.f * 1e-9)) / 1001::DOUBLE AS p FROM f a JOIN f b ON a.pathway = b.pathway AND a.it = 0 AND b.it > 0 GROUP BY a.pathway, a.f""",
    ),
)
def permutation_pvalues(spark, sf):
    return rounded(R.permutation_p(A.scores(spark, sf), A.groups(spark, sf), 1000), "f_stat")


_SECOND = _mix(f"(b * {R.SAMPLES} + j)", "it").replace("+ 42)", "+ 43)")


@query(
    "bootstrap_ci",
    with_tables(
        "labelled",
        f""", s AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i, count(*) OVER () AS n FROM samples),
 c AS (SELECT it, ({_mix("i", "it")} % n) // {R.SAMPLES} AS b, any_value(n) AS n, count(*) AS c FROM s, range(1, 1001) t(it) GROUP BY 1, 2),
 d AS (SELECT it, b * {R.SAMPLES} + {_SECOND} % least({R.SAMPLES}, n - b * {R.SAMPLES}) AS i FROM (SELECT it, b, n, unnest(range(0, c)) AS j FROM c)),
 w AS (SELECT it, i, count(*) AS w FROM d GROUP BY 1, 2), l AS (SELECT it, pathway, grp, w, score - avg(score) OVER (PARTITION BY pathway) AS x FROM w JOIN s USING (i) JOIN labelled USING (sample_id)),
 g AS (SELECT it, pathway, grp, sum(w) AS n, sum(w * x) / sum(w) AS m, (sum(w * x * x) - sum(w * x) ^ 2 / sum(w)) / nullif(sum(w) - 1, 0) AS v FROM l GROUP BY 1, 2, 3),
 e AS (SELECT a.it, a.pathway, max(abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))) AS e FROM g a JOIN g b ON a.it = b.it AND a.pathway = b.pathway AND a.grp < b.grp GROUP BY 1, 2)
 SELECT pathway, round(quantile_cont(e, 0.025), 6) AS lo, round(quantile_cont(e, 0.975), 6) AS hi FROM e GROUP BY 1""",
    ),
)
def bootstrap_ci(spark, sf):
    return rounded(R.bootstrap_ci(A.labelled(spark, sf), 1000), "lo", "hi")


@query(
    "stratified_downsample",
    f"""WITH c AS (SELECT c_custkey AS sample_id, c_mktsegment AS stratum, {_mix("c_custkey", "0")} AS m FROM customer),
 r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY m, sample_id) AS r FROM c)
 SELECT sample_id, stratum FROM r ORDER BY (r <= 101 // (SELECT count(DISTINCT stratum) FROM c))::INT DESC, m, sample_id LIMIT 101""",
)
def stratified_downsample(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("stratum"))
    return R.stratified_downsample(c, 101, "stratum")


@query("kfold_assign", with_tables("samples", f"SELECT sample_id, (ntile(5) OVER (ORDER BY {_mix('sample_id', '0')}, sample_id) - 1)::INT AS fold FROM samples"))
def kfold_assign(spark, sf):
    return R.folds(A.samples(spark, sf))


def _sub(name: str) -> str:
    return f"({ORACLES[name]})"


@query(
    "statistical_rigor",
    f"""WITH t AS (SELECT pathway, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, pathway) AS raw FROM {_sub("permutation_pvalues")}),
 q AS (SELECT pathway, p, least(1, min(raw) OVER (ORDER BY p DESC, pathway DESC ROWS UNBOUNDED PRECEDING)) AS q FROM t)
 SELECT pathway, p, round(q, 6) AS q, q < 0.05 AS significant, effect_size, lo, hi FROM q JOIN {_sub("max_pairwise_d")} USING (pathway) JOIN {_sub("bootstrap_ci")} USING (pathway)""",
)
def statistical_rigor(spark, sf):
    out = bundles.statistical_rigor(A.scores(spark, sf), A.groups(spark, sf), n_permutations=1000, n_bootstrap=1000)
    return rounded(out, "q", "effect_size", "lo", "hi")


def _scheme_effects(scheme: str) -> str:
    from .cohort import _scheme_sql

    burden = f"""SELECT sample_id, gene, sum(dosage * "{scheme}") AS burden FROM genotypes JOIN (SELECT variant_id, gene, {_scheme_sql(scheme)} FROM variants) USING (variant_id) GROUP BY 1, 2"""
    body = """SELECT a.pathway, max(abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2))) AS e FROM g a JOIN g b ON a.pathway = b.pathway AND a.grp < b.grp GROUP BY 1"""
    sql = with_tables("labelled", ", g AS (SELECT pathway, grp, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM labelled GROUP BY 1, 2) " + body)
    return f"SELECT '{scheme}' AS scheme, pathway, round(e, 6) AS effect_size FROM ({sql.replace(A.CTE['burden'], burden)})"


@query("weight_sensitivity", " UNION ALL ".join(map(_scheme_effects, ("default", "gnomad_constraint", "acmg_inspired", "cadd_percentile", "uniform"))))
def weight_sensitivity(spark, sf):
    out = bundles.weight_sensitivity(A.variants(spark, sf), A.genotypes(spark, sf), A.membership(spark), A.groups(spark, sf))
    return rounded(out, "effect_size")


@query(
    "heatmap",
    with_tables("labelled", "SELECT grp, " + ", ".join(f"round(avg(score) FILTER (pathway = 'mod3_{i}'), 9) AS mod3_{i}" for i in range(3)) + " FROM labelled GROUP BY 1"),
)
def heatmap(spark, sf):
    from ..operators.characterize import heatmap as wide

    return wide(A.labelled(spark, sf)).select("grp", *[F.round(f"mod3_{i}", 9).alias(f"mod3_{i}") for i in range(3)])


@query(
    "gene_pathway_map",
    with_tables("membership", ", o AS (SELECT pathway, gene, (CASE WHEN pathway LIKE 'mod3%' THEN 0 WHEN pathway LIKE 'mod5%' THEN 1 ELSE 2 END) * 1000 + ascii(pathway[-1:]) AS ord FROM membership) SELECT gene, max_by(pathway, ord) AS pathway FROM o GROUP BY 1"),
)
def gene_pathway_map(spark, sf):
    kind = F.when(F.startswith("pathway", F.lit("mod3")), 0).when(F.startswith("pathway", F.lit("mod5")), 1).otherwise(2)
    ordered = A.membership(spark).withColumn("ord", kind * 1000 + F.ascii(F.substring("pathway", -1, 1)))
    return X.gene_pathway(ordered)
