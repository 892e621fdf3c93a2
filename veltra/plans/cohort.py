"""Queries on burdens, scores, quality control and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions import weights as W
from ..operators import burden as B
from ..operators import crossref as X
from ..operators import qc
from ..session import table
from . import analogue as A
from .analogue import rounded, with_tables
from .registry import query


@query("gene_burden", with_tables("burden", "SELECT sample_id, gene, round(burden, 6) AS burden FROM burden"))
def gene_burden(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.burden(spark, sf), "burden")


@query("pathway_scores", with_tables("scores", "SELECT sample_id, pathway, round(score, 9) AS score FROM scores"))
def pathway_scores(spark, sf):
    return A.scores(spark, sf).withColumn("score", F.round("score", 9))  # scores have exact ties at the seventh digit


Z = """SELECT sample_id, pathway, (score - avg(score) OVER p) / stddev_samp(score) OVER p AS z FROM scores
 WINDOW p AS (PARTITION BY pathway)"""


@query("pathway_zscores", with_tables("scores", f"SELECT sample_id, pathway, round(z, 6) AS score FROM ({Z})"))
def pathway_zscores(spark, sf):
    return rounded(B.zscores(A.scores(spark, sf)), "score")


@query(
    "flagship_top_pathway",
    with_tables(
        "scores",
        f""", z AS (SELECT sample_id, pathway, round(z, 6) AS z FROM ({Z}))
 SELECT sample_id, first(pathway ORDER BY z DESC, pathway) AS top_pathway, max(z) AS top_score FROM z GROUP BY 1""",
    ),
)
def flagship_top_pathway(spark, sf):
    return B.top_pathway(rounded(B.zscores(A.scores(spark, sf)), "score"))


@query(
    "agg_size_normalized",
    with_tables("scores", "SELECT sample_id, pathway, round(score / sqrt((SELECT any_value(n) FROM known k WHERE k.pathway = s.pathway)), 9) AS score FROM scores s"),
)
def agg_size_normalized(spark, sf):
    return A.scores(spark, sf, "size_normalized").withColumn("score", F.round("score", 9))


@query(
    "agg_median",
    with_tables(
        "samples known",
        """SELECT s.sample_id, k.pathway, round(median(coalesce(b.burden, 0)), 6) AS score FROM samples s CROSS JOIN known k
 LEFT JOIN burden b ON b.sample_id = s.sample_id AND b.gene = k.gene GROUP BY 1, 2""",
    ),
)
def agg_median(spark, sf):
    return rounded(A.scores(spark, sf, "median"), "score")


@query(
    "zero_variance_filter",
    with_tables(
        "scores",
        """, s AS (SELECT sample_id, pathway, score FROM scores UNION ALL SELECT sample_id, 'constant', 1.0 FROM samples)
 SELECT pathway, count(*) AS n FROM s GROUP BY 1 HAVING stddev_samp(score) > 0""",
    ),
)
def zero_variance_filter(spark, sf):
    constant = A.samples(spark, sf).select("sample_id", F.lit("constant").alias("pathway"), F.lit(1.0).cast("double").alias("score"))
    return B.drop_constant(A.scores(spark, sf).unionByName(constant)).groupBy("pathway").agg(F.count(F.lit(1)).alias("n"))


def _scheme_sql(name: str) -> str:
    w = dict(zip(W.FIELDS, W.SCHEMES[name], strict=True))
    lof = " OR ".join(f"consequence LIKE '%{t}%'" for t in W.LOF_TERMS)
    return f"""(CASE WHEN {lof} THEN {w["lof"]} WHEN consequence LIKE '%missense%' THEN
 CASE WHEN cadd >= {w["cadd_high"]} THEN {w["high"]} WHEN cadd >= {w["cadd_moderate"]} THEN {w["moderate"]}
 WHEN cadd >= {w["cadd_low"]} THEN {w["low"]} ELSE {w["low"] * 0.5} END
 WHEN consequence LIKE '%inframe%' THEN CASE WHEN cadd >= {w["cadd_high"]} THEN {w["moderate"]} ELSE {w["other"]} END
 ELSE {w["other"]} END)::DOUBLE AS {name}"""


@query("weight_schemes", with_tables("variants", f"SELECT variant_id, {', '.join(map(_scheme_sql, W.SCHEMES))} FROM variants"))
def weight_schemes(spark, sf):
    v = A.variants(spark, sf)
    return v.select("variant_id", *[W.scheme_weight(F.col("consequence"), F.col("cadd"), s).alias(s) for s in W.SCHEMES])


METRICS = """, n AS (SELECT count(*)::DOUBLE AS n FROM samples),
 c AS (SELECT variant_id, count(*) AS stored, count(*) FILTER (dosage = 1) AS het, count(*) FILTER (dosage = 2) AS hom FROM g GROUP BY 1),
 m AS (SELECT v.variant_id, v.qual, n.n AS called, coalesce(het, 0) AS het, coalesce(hom, 0) AS hom, (coalesce(het, 0) + 2 * coalesce(hom, 0)) / (2 * n.n) AS p
 FROM variants v LEFT JOIN c USING (variant_id) CROSS JOIN n),
 x AS (SELECT variant_id, qual, called / called AS call_rate, least(p, 1 - p) AS maf, CASE WHEN p > 0 AND p < 1 THEN
 (called - het - hom - (1 - p) * (1 - p) * called) ^ 2 / ((1 - p) * (1 - p) * called) + (het - 2 * p * (1 - p) * called) ^ 2 / (2 * p * (1 - p) * called)
 + (hom - p * p * called) ^ 2 / (p * p * called) ELSE 0 END AS hwe_chi2 FROM m)"""
PLANTED = ", g AS (SELECT DISTINCT o_custkey AS sample_id, l_partkey AS variant_id, ((o_custkey + l_partkey) % 3)::INT AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _metrics(spark, sf, genotypes):
    n = A.samples(spark, sf).count()
    return qc.variant_metrics(A.variants(spark, sf), genotypes, n)


def _planted(spark, sf):
    g = A.genotypes(spark, sf)
    return g.withColumn("dosage", ((F.col("sample_id") + F.col("variant_id")) % 3).cast("int"))


@query(
    "call_rate_maf",
    with_tables("variants genotypes samples", ", g AS (SELECT * FROM genotypes)" + METRICS + " SELECT variant_id, call_rate, round(maf, 6) AS maf FROM x"),
)
def call_rate_maf(spark, sf):
    return rounded(_metrics(spark, sf, A.genotypes(spark, sf)).select("variant_id", "call_rate", "maf"), "maf")


@query("hwe_chi2", with_tables("variants samples", PLANTED + METRICS + " SELECT variant_id, round(hwe_chi2, 6) AS hwe_chi2 FROM x"))
def hwe_chi2(spark, sf):
    return rounded(_metrics(spark, sf, _planted(spark, sf)).select("variant_id", "hwe_chi2"), "hwe_chi2")


@query(
    "sequential_qc_reasons",
    with_tables(
        "variants samples",
        PLANTED
        + METRICS
        + f""" SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN qual < 30 THEN 'low_qual' WHEN call_rate < 0.9 THEN 'low_call_rate'
 WHEN hwe_chi2 > {qc.CHI2_AT_1E6} THEN 'hwe_fail' WHEN maf > 0.01 THEN 'high_maf' END AS reason FROM x) GROUP BY 1""",
    ),
)
def sequential_qc_reasons(spark, sf):
    judged = qc.removal_reason(_metrics(spark, sf, _planted(spark, sf)))
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "gq_dp_mask",
    """SELECT l_returnflag AS flag, count(*) AS n, count(*) FILTER (l_quantity < 10 OR l_linenumber < 2) AS masked,
 sum(CASE WHEN l_quantity < 10 OR l_linenumber < 2 THEN NULL ELSE l_partkey % 3 END)::BIGINT AS dosage FROM lineitem GROUP BY 1""",
)
def gq_dp_mask(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("gq"), F.col("l_linenumber").alias("dp"), (F.col("l_partkey") % 3).alias("dosage")
    )
    masked = qc.mask_genotypes(rows, min_gq=10, min_dp=2)
    return masked.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count_if("masked").alias("masked"), F.sum("dosage").alias("dosage"))


@query(
    "annotation_coverage",
    with_tables(
        "variants",
        """SELECT count(*) AS n_variants, round(100.0 * count(*) FILTER (gene <> '') / count(*), 6) AS pct_gene,
 round(100.0 * count(*) FILTER (consequence <> '') / count(*), 6) AS pct_consequence, round(100.0 * count(*) FILTER (cadd > 0) / count(*), 6) AS pct_cadd,
 count(*) FILTER (gene <> '') * 2 >= count(*) AS usable FROM variants""",
    ),
)
def annotation_coverage(spark, sf):
    return rounded(qc.annotation_coverage(A.variants(spark, sf)), "pct_gene", "pct_consequence", "pct_cadd")


@query(
    "sample_overlap_semi_anti",
    with_tables(
        "samples",
        """, p AS (SELECT c_custkey AS sample_id FROM customer WHERE c_acctbal > 0)
 SELECT 'both' AS side, count(*) AS v FROM samples WHERE sample_id IN (FROM p) UNION ALL
 SELECT 'data_only', count(*) FROM samples WHERE sample_id NOT IN (FROM p) UNION ALL
 SELECT 'phenotypes_only', count(*) FROM p WHERE sample_id NOT IN (FROM samples)""",
    ),
)
def sample_overlap_semi_anti(spark, sf):
    phenotypes = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("sample_id"))
    return qc.sample_overlap(A.samples(spark, sf), phenotypes)


INFO = """SELECT p_partkey AS variant_id, 'GENE=' || p_brand || ';CONSEQUENCE=' || CASE WHEN p_size % 7 = 0 THEN '.' ELSE p_type END
 || CASE WHEN p_size % 3 = 0 THEN ';SOMATIC' ELSE '' END || ';CADD=' || p_size || ',' || (p_size + 1) AS info FROM part"""


def _info(spark, sf):
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_size") % 7 == 0, ".").otherwise(F.col("p_type"))
    flag = F.when(F.col("p_size") % 3 == 0, ";SOMATIC").otherwise("")
    text = F.concat(F.lit("GENE="), "p_brand", F.lit(";CONSEQUENCE="), kind, flag, F.lit(";CADD="), F.col("p_size").cast("string"), F.lit(","), (F.col("p_size") + 1).cast("string"))
    return p.select(F.col("p_partkey").alias("variant_id"), text.alias("info"))


@query(
    "parse_info",
    f"""SELECT variant_id, regexp_extract(info, 'GENE=([^;]*)', 1) AS gene, replace(regexp_extract(info, 'CONSEQUENCE=([^;]*)', 1), '.', '') AS consequence,
 info LIKE '%;SOMATIC%' AS somatic, regexp_extract(info, 'CADD=([0-9]+)', 1)::DOUBLE AS cadd, regexp_extract(info, 'CADD=[0-9]+,([0-9]+)', 1)::DOUBLE AS cadd_second FROM ({INFO})""",
)
def parse_info(spark, sf):
    info = F.col("info")
    return _info(spark, sf).select(
        "variant_id",
        G.clean_annotation(G.info_value(info, "GENE")).alias("gene"),
        G.clean_annotation(G.info_value(info, "CONSEQUENCE")).alias("consequence"),
        G.info_value(info, "SOMATIC").isNotNull().alias("somatic"),
        G.safe_double(G.clean_annotation(G.info_value(info, "CADD"))).alias("cadd"),
        G.safe_double(G.allele_value(G.info_value(info, "CADD"), F.lit(2), F.lit(2))).alias("cadd_second"),
    )


GT = """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN './.' WHEN l_partkey % 13 = 0 THEN '.' WHEN l_partkey % 17 = 0 THEN '0/.' WHEN l_partkey % 19 = 0 THEN 'X/Y'
 ELSE (l_partkey % 3) || CASE WHEN l_suppkey % 2 = 0 THEN '|' ELSE '/' END || (l_suppkey % 3) || ':35:99' END AS gt FROM lineitem"""


@query(
    "parse_genotype",
    f"""SELECT l_orderkey, l_linenumber, valid, CASE WHEN valid THEN (a = '1')::INT + (b = '1')::INT ELSE 0 END AS ref_alt1, CASE WHEN valid THEN (a = '2')::INT + (b = '2')::INT ELSE 0 END AS ref_alt2
 FROM (SELECT l_orderkey, l_linenumber, regexp_matches(gt, '^[0-9]+[/|][0-9]+(:.*)?$') AS valid, regexp_extract(gt, '^([0-9]+)[/|]', 1) AS a, regexp_extract(gt, '^[0-9]+[/|]([0-9]+)', 1) AS b FROM ({GT}))""",
)
def parse_genotype(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    sep = F.when(F.col("l_suppkey") % 2 == 0, "|").otherwise("/")
    plain = F.concat((F.col("l_partkey") % 3).cast("string"), sep, (F.col("l_suppkey") % 3).cast("string"), F.lit(":35:99"))
    gt = plain
    for m, text in ((19, "X/Y"), (17, "0/."), (13, "."), (11, "./.")):
        gt = F.when(F.col("l_partkey") % m == 0, text).otherwise(gt)
    one, two = G.genotype(F.col("gt"), 1), G.genotype(F.col("gt"), 2)
    return l.select("l_orderkey", "l_linenumber", gt.alias("gt")).select(
        "l_orderkey", "l_linenumber", one["valid"].alias("valid"), one["dosage"].alias("ref_alt1"), two["dosage"].alias("ref_alt2")
    )


@query(
    "expand_multiallelic",
    """SELECT p_partkey AS site, 'v' || p_partkey || CASE WHEN p_size % 3 > 0 THEN '_' || i ELSE '' END AS variant_id, i::INT AS allele,
 (p_size + i - 1)::DOUBLE AS cadd, ((p_partkey % 4 = i)::INT + (p_size % 4 = i)::INT) AS dosage FROM part, range(1, 4) t(i) WHERE i <= p_size % 3 + 1""",
)
def expand_multiallelic(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_size") % 3 + 1
    gt = F.concat((F.col("p_partkey") % 4).cast("string"), F.lit("/"), (F.col("p_size") % 4).cast("string"))
    cadd = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.col("p_size") + i).cast("string")), ",")
    rows = p.select(F.col("p_partkey").alias("site"), n.alias("alleles"), gt.alias("gt"), cadd.alias("cadd"), F.explode(F.sequence(F.lit(1), n)).alias("allele"))
    suffix = F.when(F.col("alleles") > 1, F.concat(F.lit("_"), F.col("allele").cast("string"))).otherwise("")
    return rows.select(
        "site",
        F.concat(F.lit("v"), F.col("site").cast("string"), suffix).alias("variant_id"),
        "allele",
        G.safe_double(G.allele_value(F.col("cadd"), F.col("allele"), F.col("alleles"))).alias("cadd"),
        G.genotype(F.col("gt"), F.col("allele"))["dosage"].alias("dosage"),
    )


@query(
    "gmt_explode",
    "SELECT 'REGION_' || n_regionkey AS pathway, n_name AS gene, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::INT AS ord FROM nation",
)
def gmt_explode(spark, sf):
    from ..sources.genesets import parse_gmt

    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("g"))
    lines = n.select(F.concat_ws("\t", F.concat(F.lit("REGION_"), F.col("n_regionkey").cast("string")), F.lit("about"), F.array_join("g", "\t")).alias("value"))
    return parse_gmt(lines)


@query(
    "annotation_fallback_join",
    """, a AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'rs' || p_partkey WHEN 1 THEN p_brand || ':' || p_partkey ELSE p_brand || '_' || p_partkey END AS key, p_type AS note FROM part WHERE p_size > 10
 UNION ALL SELECT p_brand || '_' || p_partkey, 'late' FROM part WHERE p_size <= 5)
 SELECT p_partkey AS variant_id, coalesce(x.note, y.note, z.note) AS note FROM part
 LEFT JOIN a x ON x.key = 'rs' || p_partkey LEFT JOIN a y ON y.key = p_brand || ':' || p_partkey LEFT JOIN a z ON z.key = p_brand || '_' || p_partkey""".replace(", a AS", "WITH a AS", 1),
)
def annotation_fallback_join(spark, sf):
    p = table(spark, sf, "part").withColumn("k", F.col("p_partkey").cast("string"))
    rs, colon, low = F.concat(F.lit("rs"), "k"), F.concat("p_brand", F.lit(":"), "k"), F.concat("p_brand", F.lit("_"), "k")
    key = F.when(F.col("p_partkey") % 3 == 0, rs).when(F.col("p_partkey") % 3 == 1, colon).otherwise(low)
    notes = p.where("p_size > 10").select(key.alias("key"), F.col("p_type").alias("note"))
    notes = notes.union(p.where("p_size <= 5").select(low, F.lit("late")))
    rows = p.select(F.col("p_partkey").alias("variant_id"), "p_brand", "k")
    return X.lookup_by_keys(rows, notes, [rs, colon, low], ["note"]).select("variant_id", "note")


@query(
    "annovar_map",
    """SELECT p_partkey AS variant_id, CASE p_size % 5 WHEN 0 THEN 'inframe_insertion' WHEN 1 THEN 'frameshift_variant' WHEN 2 THEN 'missense_variant' WHEN 3 THEN 'synonymous_variant' ELSE 'unknown' END AS consequence FROM part""",
)
def annovar_map(spark, sf):
    text = F.element_at(F.array(*map(F.lit, ["nonframeshift insertion", "Frameshift Deletion", "nonsynonymous SNV", "synonymous SNV", "intronic"])), F.col("p_size") % 5 + 1)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("variant_id"), W.annovar_consequence(text).alias("consequence"))


@query(
    "cluster_labels",
    with_tables(
        "labelled",
        """, m AS (SELECT grp, pathway, round(avg(score), 6) AS m FROM labelled GROUP BY 1, 2), t AS (SELECT grp, first(pathway ORDER BY m DESC, pathway) AS top_pathway FROM m GROUP BY 1)
 SELECT grp, top_pathway, 'subtype_' || grp AS label FROM t""",
    ),
)
def cluster_labels(spark, sf):
    means = A.labelled(spark, sf).groupBy("grp", "pathway").agg(F.round(F.avg("score"), 6).alias("score"))
    top = B.top_pathway(means.withColumnRenamed("grp", "sample_id")).withColumnRenamed("sample_id", "grp")
    return top.select("grp", "top_pathway", W.subtype_label(F.col("top_pathway"), F.col("grp")).alias("label"))
