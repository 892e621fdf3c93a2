"""The cohort tables that the queries use, made from the driver's tables, and the same as SQL.

A customer is a sample, a part is a variant, its brand the gene, its type the consequence, its size the CADD score; the
dosage is how often a customer bought a part, at most 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import burden as B
from ..session import cut, table

# The consequence that stands for each type of part.
CONSEQUENCES = {
    "PROMO": "frameshift_variant",
    "LARGE": "missense_variant",
    "MEDIUM": "missense_variant",
    "SMALL": "inframe_insertion",
}


def variants(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.lit("synonymous_variant")
    for k, v in CONSEQUENCES.items():
        kind = F.when(F.col("p_type") == k, v).otherwise(kind)
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("variant_id"),
        F.col("p_brand").alias("gene"),
        kind.alias("consequence"),
        F.when(F.col("p_size") <= 5, 0.0).otherwise(F.col("p_size").cast("double")).alias("cadd"),
        (F.round(F.col("p_retailprice") * 100).cast("long") % 100).cast("double").alias("qual"),
    )


def genotypes(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    counts = joined.groupBy(F.col("o_custkey").alias("sample_id"), F.col("l_partkey").alias("variant_id")).count()
    return counts.select("sample_id", "variant_id", F.least(F.lit(2), F.col("count")).cast("int").alias("dosage"))


def membership(spark: SparkSession) -> DataFrame:
    """Gene sets: overlapping ones, one with a gene twice, one with a single gene, one that no gene is in."""
    rows = [(f"mod{m}_{g % m}", f"Brand#{g}") for m in (3, 5) for g in range(1, 26)]
    rows += [("first", f"Brand#{g}") for g in range(1, 5)] + [("twice", f"Brand#{g}") for g in (1, 1, 2)]
    rows += [("single", "Brand#1"), ("unmatched", "NONE1"), ("unmatched", "NONE2")]
    return spark.createDataFrame(rows, "pathway string, gene string")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id")).distinct()


def burden(spark: SparkSession, sf: str) -> DataFrame:
    return B.gene_burden(variants(spark, sf), genotypes(spark, sf))


def scores(spark: SparkSession, sf: str, method: str = "mean") -> DataFrame:
    return B.pathway_scores(cut(burden(spark, sf)), membership(spark), samples(spark, sf), method)


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select("sample_id", F.concat(F.lit("g"), (F.col("sample_id") % 3).cast("string")).alias("grp"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).join(groups(spark, sf), "sample_id")


def batched(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("batch"))
    return scores(spark, sf).join(customers, "sample_id")


def expression(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities by supplier (sample) and brand (gene)."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return joined.groupBy(F.col("l_suppkey").alias("sample_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def covariate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_acctbal").alias("x"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    vectors = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vectors.alias("features"), "label")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


WEIGHT = """(CASE WHEN consequence LIKE '%frameshift%' OR consequence LIKE '%stop%' THEN 1.0
 WHEN consequence LIKE '%missense%' AND cadd > 25 THEN 0.5 ELSE 0.1 END)::DOUBLE
 * least(CASE WHEN cadd > 0 THEN cadd WHEN consequence LIKE '%frameshift%' OR consequence LIKE '%stop%' THEN 35
 WHEN consequence LIKE '%missense%' THEN 20 ELSE 10 END, 40)::DOUBLE / 40"""

CTE = {
    "variants": """SELECT p_partkey AS variant_id, p_brand AS gene,
 CASE p_type WHEN 'PROMO' THEN 'frameshift_variant' WHEN 'LARGE' THEN 'missense_variant' WHEN 'MEDIUM' THEN 'missense_variant'
 WHEN 'SMALL' THEN 'inframe_insertion' ELSE 'synonymous_variant' END AS consequence,
 CASE WHEN p_size <= 5 THEN 0.0::DOUBLE ELSE p_size::DOUBLE END AS cadd,
 (round(p_retailprice * 100)::BIGINT % 100)::DOUBLE AS qual FROM part""",
    "genotypes": """SELECT o_custkey AS sample_id, l_partkey AS variant_id, least(2, count(*))::INT AS dosage
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "membership": """SELECT 'mod3_' || (g % 3) AS pathway, 'Brand#' || g AS gene FROM range(1, 26) t(g)
 UNION ALL SELECT 'mod5_' || (g % 5), 'Brand#' || g FROM range(1, 26) t(g)
 UNION ALL SELECT 'first', 'Brand#' || g FROM range(1, 5) t(g)
 UNION ALL SELECT * FROM (VALUES ('twice', 'Brand#1'), ('twice', 'Brand#1'), ('twice', 'Brand#2'), ('single', 'Brand#1'),
 ('unmatched', 'NONE1'), ('unmatched', 'NONE2')) v""",
    "samples": "SELECT DISTINCT o_custkey AS sample_id FROM orders",
    "burden": f"""SELECT sample_id, gene, sum(dosage * w) AS burden FROM genotypes
 JOIN (SELECT variant_id, gene, {WEIGHT} AS w FROM variants) USING (variant_id) GROUP BY 1, 2""",
    "known": """SELECT pathway, gene, count(*) OVER (PARTITION BY pathway) AS n FROM membership
 WHERE gene IN (SELECT gene FROM burden) QUALIFY n >= 2""",
    "scores": """SELECT s.sample_id, p.pathway, coalesce(v.score, 0) AS score FROM samples s
 CROSS JOIN (SELECT DISTINCT pathway FROM known) p
 LEFT JOIN (SELECT sample_id, pathway, sum(burden) / any_value(n) AS score FROM burden JOIN known USING (gene) GROUP BY 1, 2) v
 ON v.sample_id = s.sample_id AND v.pathway = p.pathway""",
    "labelled": "SELECT *, 'g' || (sample_id % 3) AS grp FROM scores",
    "batched": "SELECT sample_id, c_mktsegment AS batch, pathway, score FROM scores JOIN customer ON c_custkey = sample_id",
    "expression": """SELECT l_suppkey AS sample_id, p_brand AS gene, sum(l_quantity) AS value
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "sets": """SELECT pathway, gene, count(*) OVER (PARTITION BY pathway) AS size
 FROM (SELECT DISTINCT pathway, gene FROM membership WHERE gene IN (SELECT gene FROM expression)) QUALIFY size >= 2""",
    "points": "SELECT vec_id AS id, embedding::DOUBLE[] AS features, label FROM embeddings",
}
NEEDS = {
    "burden": ["variants", "genotypes"],
    "known": ["membership", "burden"],
    "scores": ["samples", "known"],
    "labelled": ["scores"],
    "batched": ["scores"],
    "sets": ["membership", "expression"],
}


def with_tables(names: str, body: str) -> str:
    """body after WITH clauses of the named tables and all that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    clauses = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in order)
    joint = ",\n" if body.lstrip().startswith(",") else "\n"
    return f"WITH {clauses}{joint}{body.lstrip().lstrip(',')}"
