"""Queries on the file sources: the driver's tables are written as the files that a source reads, and read back.

Files go to the shared folder, a new one for each run, through Spark's writers, so that any cluster can read them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..operators import qc
from ..session import ensure_checkpoint_dir, table
from ..sources import annotations, blocks, genesets, tables, variants
from . import analogue as A
from .analogue import rounded, with_tables
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, name: str, header: str | None = None, order: str = "o") -> str:
    """df (o, value) as one text file in that order, below a header."""
    spark = df.sparkSession
    rows = df.select(F.col(order).cast("long").alias("o"), "value")
    if header is not None:
        rows = spark.createDataFrame([(-1, header)], "o long, value string").unionByName(rows)
    path = _folder(spark, name)
    rows.repartitionByRange(1, "o").sortWithinPartitions("o").select("value").write.text(path)
    return path


def _cat(*parts: str | Column) -> Column:
    """Parts one after another: @name is a column, other strings are text."""
    one = lambda p: F.col(p[1:]).cast("string") if isinstance(p, str) and p.startswith("@") else F.lit(p) if isinstance(p, str) else p.cast("string")
    return F.concat(*map(one, parts))


#: Ten samples; a part is a site with one alternative allele, or two where its size divides by four.
N_SAMPLES = 10
VCF_HEADER = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"S{i}" for i in range(N_SAMPLES))


def vcf_file(spark: SparkSession, sf: str) -> str:
    p = table(spark, sf, "part").withColumn("two", F.col("p_size") % 4 == 0)
    call = lambda i: F.when((F.col("p_partkey") + i) % 11 == 0, "./.").otherwise(
        F.concat(((F.col("p_partkey") + i) % 2).cast("string"), F.lit("/"), F.when(F.col("two"), (F.col("p_size") + i) % 3).otherwise((F.col("p_size") + i) % 2).cast("string"))
    )
    info = _cat("GENE=", F.when(F.col("p_size") % 7 == 0, ".").otherwise(F.col("p_brand")), ";CONSEQUENCE=", "@p_type", ";CADD=", F.when(F.col("two"), _cat("@p_size", ",", F.col("p_size") + 1)).otherwise(F.col("p_size").cast("string")))
    fields = [
        F.concat(F.lit("chr"), (F.col("p_partkey") % 22 + 1).cast("string")), F.col("p_partkey").cast("string"),
        F.when(F.col("p_partkey") % 2 == 0, _cat("rs", "@p_partkey")).otherwise("."), F.lit("A"), F.when(F.col("two"), "C,G").otherwise("C"), F.col("p_size").cast("string"), F.lit("PASS"), info, F.lit("GT:DP"),
    ]
    calls = [F.concat(call(i), F.lit(":30")) for i in range(N_SAMPLES)]
    broken = F.when(F.col("p_partkey") % 50 == 0, F.lit("chr1\t5\tshort line"))
    rows = p.select(F.col("p_partkey").alias("o"), F.coalesce(broken, F.concat_ws("\t", *fields, *calls)).alias("value"))
    return _lines(rows, "vcf", VCF_HEADER)


SITES = """sites AS (SELECT p_partkey AS k, p_size AS z, p_brand AS b, p_type AS ty, CASE WHEN p_size % 4 = 0 THEN 2 ELSE 1 END AS n FROM part WHERE p_partkey % 50 <> 0),
 alleles AS (SELECT *, 'chr' || (k % 22 + 1) AS chrom, CASE a WHEN 1 THEN 'C' ELSE 'G' END AS alt FROM sites, range(1, 3) t(a) WHERE a <= n),
 named AS (SELECT *, CASE WHEN k % 2 = 1 THEN chrom || '_' || k || '_A_' || alt ELSE 'rs' || k || CASE WHEN n > 1 THEN '_' || a ELSE '' END END AS variant_id FROM alleles)"""


@query(
    "vcf_variants",
    f"""WITH {SITES} SELECT variant_id, chrom, k AS pos, alt, a::INT AS allele, n::INT AS n_alts, z::DOUBLE AS qual, CASE WHEN z % 7 = 0 THEN '' ELSE b END AS gene, ty AS consequence, (z + a - 1)::DOUBLE AS cadd FROM named""",
)
def vcf_variants(spark: SparkSession, sf: str) -> DataFrame:
    v = variants.read_vcf(spark, vcf_file(spark, sf)).variants
    return v.select("variant_id", "chrom", "pos", "alt", F.col("allele").cast("int").alias("allele"), F.col("n_alts").cast("int").alias("n_alts"), "qual", "gene", "consequence", "cadd")


CALLS = """, calls AS (SELECT variant_id, a, i, (k + i) % 11 <> 0 AS valid, (k + i) % 2 AS x, CASE WHEN n = 2 THEN (z + i) % 3 ELSE (z + i) % 2 END AS y FROM named, range(0, 10) t(i))"""


@query(
    "vcf_genotypes",
    f"""WITH {SITES}{CALLS} SELECT variant_id, 'S' || i AS sample_id, CASE WHEN valid THEN (x = a)::INT + (y = a)::INT ELSE 0 END AS dosage, valid, 30.0::DOUBLE AS dp FROM calls""",
)
def vcf_genotypes(spark, sf):
    return variants.read_vcf(spark, vcf_file(spark, sf)).genotypes.select("variant_id", "sample_id", "dosage", "valid", "dp")


@query(
    "vcf_sample_subset",
    f"""WITH {SITES}{CALLS} SELECT variant_id, 'S' || i AS sample_id, CASE WHEN valid THEN (x = a)::INT + (y = a)::INT END AS dosage FROM calls WHERE i IN (2, 7) AND (NOT valid OR x = a OR y = a)""",
)
def vcf_sample_subset(spark, sf):
    """Two samples, sparse, missing calls as nulls."""
    read = variants.read_vcf(spark, vcf_file(spark, sf), ["S2", "S7", "absent"], missing_as_null=True, sparse=True)
    return read.genotypes.select("variant_id", "sample_id", "dosage")


@query(
    "vcf_calls_sql",
    f"""WITH {SITES}{CALLS} SELECT variant_id, gene, cadd, 'S' || i AS sample_id, dosage FROM (SELECT c.*, CASE WHEN valid THEN (x = c.a)::INT + (y = c.a)::INT ELSE 0 END AS dosage, CASE WHEN z % 7 = 0 THEN NULL ELSE b END AS gene, (z + c.a - 1)::DOUBLE AS cadd
 FROM calls c JOIN (SELECT variant_id, z, b FROM named) USING (variant_id)) WHERE dosage > 0""",
)
def vcf_calls_sql(spark, sf):
    """The lines through the table function, in SQL: its columns follow from the INFO keys that are asked for."""
    from ..functions.table_functions import register_table_functions

    register_table_functions(spark)
    names = ",".join(f"S{i}" for i in range(N_SAMPLES))
    return spark.sql(
        f"SELECT variant_id, gene, cadd, sample_id, dosage FROM vcf_calls(TABLE({{lines}}), samples => '{names}', info => 'GENE, CADD double') WHERE dosage > 0", lines=spark.read.text(vcf_file(spark, sf))
    )


def vcf_block_folder(spark: SparkSession, sf: str) -> str:
    """The lines of vcf_file in several block-gzip files, in order of chromosome and position inside each."""
    body = spark.read.text(vcf_file(spark, sf)).where("not startswith(value, '#')")
    f = F.split("value", "\t", 3)
    path = _folder(spark, "vcf-blocks")
    blocks.write_blocks(body.repartition(4, F.hash("value")).sortWithinPartitions(F.get(f, 0), F.get(f, 1).try_cast("long")), path, VCF_HEADER)
    return path


@query("vcf_blocks", f"""WITH {SITES}{CALLS} SELECT variant_id, 'S' || i AS sample_id, CASE WHEN valid THEN (x = a)::INT + (y = a)::INT ELSE 0 END AS dosage, valid FROM calls""")
def vcf_blocks(spark, sf):
    """All calls of the lines, written as block-gzip files and read by ranges of blocks."""
    return variants.read_vcf(spark, vcf_block_folder(spark, sf), blocks=True).genotypes.select("variant_id", "sample_id", "dosage", "valid")


@query(
    "vcf_blocks_region",
    f"""WITH {SITES}{CALLS} SELECT variant_id, 'S' || i AS sample_id, CASE WHEN valid THEN (x = a)::INT + (y = a)::INT ELSE 0 END AS dosage FROM calls JOIN (SELECT variant_id, chrom, k FROM named) USING (variant_id)
 WHERE i IN (2, 7) AND chrom = 'chr5' AND k BETWEEN 30 AND 1500""",
)
def vcf_blocks_region(spark, sf):
    """Two samples of a region, which the reader keeps to."""
    read = variants.read_vcf(spark, vcf_block_folder(spark, sf), ["S2", "S7"], region=("chr5", 30, 1500), blocks=True)
    return read.genotypes.select("variant_id", "sample_id", "dosage")


@query(
    "vcf_quality_report",
    f"""WITH {SITES}{CALLS}, r AS (SELECT (SELECT count(*) FROM part) AS total_variants, (SELECT count(*) FROM named) AS parsed_variants, (SELECT count(*) FROM part WHERE p_partkey % 50 = 0) AS skipped_variants,
 (SELECT count(*) FROM sites WHERE n > 1) AS multi_allelic_variants, (SELECT count(*) FROM named WHERE n > 1) AS multi_allelic_expanded, (SELECT count(*) FROM named WHERE z % 7 <> 0) AS variants_with_gene,
 (SELECT count(*) FROM named) AS variants_with_consequence, (SELECT count(*) FROM named WHERE z + a - 1 > 0) AS variants_with_cadd, (SELECT count(*) FROM calls WHERE NOT valid) AS missing_genotypes)
 SELECT name, v FROM (UNPIVOT r ON COLUMNS(*) INTO NAME name VALUE v) UNION ALL SELECT 'is_usable', 1""",
)
def vcf_quality_report(spark, sf):
    report = variants.quality_report(variants.read_vcf(spark, vcf_file(spark, sf)))
    counts = {k: v for k, v in vars(report).items() if isinstance(v, int) and k != "min_gene_coverage"} | {"is_usable": int(report.is_usable)}
    return spark.createDataFrame(list(counts.items()), "name string, v long")


@query(
    "vcf_preflight",
    f"""WITH {SITES}, v AS (SELECT 'usable' AS kind, 'true' AS text UNION ALL SELECT 'warning', (SELECT count(*) FROM part WHERE p_partkey % 50 = 0) || ' lines have fewer than 9 fields')
 SELECT * FROM v""",
)
def vcf_preflight(spark, sf):
    usable, report, advice = variants.validate_vcf(spark, vcf_file(spark, sf))
    rows = [("usable", str(usable).lower())] + [("warning", w) for w in report.warnings] + [("error", e) for e in report.errors] + [("advice", a) for a in advice]
    return spark.createDataFrame(rows, "kind string, text string")


@query(
    "vcf_written",
    with_tables("variants", "SELECT 'chr1' AS chrom, variant_id AS pos, gene, consequence, CASE WHEN cadd = 0 THEN 0 ELSE cadd END AS cadd FROM variants"),
)
def vcf_written(spark, sf):
    """Annotated sites written as VCF lines, whose INFO is read back."""
    v = A.variants(spark, sf).select(
        F.lit("chr1").alias("chrom"), F.col("variant_id").alias("pos"), F.lit("").alias("id"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), "qual", F.lit("PASS").alias("filter"), "gene", "consequence", "cadd"
    )
    path = _folder(spark, "vcf-written")
    variants.write_vcf(v, path)
    f = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    info = lambda k: G.info_value(F.col("f")[7], k)
    return f.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), info("GENE").alias("gene"), info("CONSEQUENCE").alias("consequence"), G.safe_double(info("CADD")).alias("cadd"))


SETS = "SELECT 'R' || n_regionkey AS pathway, n_name AS gene, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::INT AS ord FROM nation"


def gmt_file(spark: SparkSession, sf: str, strict: bool = False) -> str:
    """A line for each region; unless strict also a comment, a line without genes and an earlier line of the same name."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "\t").alias("g"))
    rows = n.select((F.col("n_regionkey") + 10).alias("o"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("\tabout\t"), F.col("g")).alias("value"))
    if not strict:
        more = [(0, "# a comment"), (1, "R0\tearlier\tOLD1\tOLD2"), (2, "SHORT\tno genes"), (3, "")]
        rows = rows.unionByName(spark.createDataFrame(more, "o int, value string"))
    return _lines(rows, "gmt")


@query("gmt_lenient", SETS)
def gmt_lenient(spark, sf):
    return genesets.read_gmt(spark, gmt_file(spark, sf))


@query("gmt_strict", f"SELECT * FROM ({SETS}) UNION ALL SELECT 'refused', 'line 2: duplicate name; line 3: fewer than 3 fields', 0")
def gmt_strict(spark, sf):
    """A good file is read; of a bad one the problems are told."""
    good = genesets.validate_gmt(spark, gmt_file(spark, sf, strict=True))
    try:
        genesets.validate_gmt(spark, gmt_file(spark, sf))
        told = "accepted"
    except genesets.GmtError as e:
        told = "; ".join(str(e).split("; ")[:2])
    return good.unionByName(spark.createDataFrame([("refused", told, 0)], "pathway string, gene string, ord int"))


@query("reactome_sets", "SELECT 'R-HSA-' || n_regionkey AS pathway, n_name AS gene, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::INT AS ord FROM nation WHERE n_regionkey % 2 = 0")
def reactome_sets(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "\t").alias("g"))
    name = F.concat(F.when(F.col("n_regionkey") % 2 == 0, "R-HSA-").otherwise("R-MMU-"), F.col("n_regionkey").cast("string"))
    return genesets.read_reactome(spark, _lines(n.select(F.col("n_regionkey").alias("o"), F.concat(name, F.lit("\tset\t"), F.col("g")).alias("value")), "reactome"))


@query("phenotypes_csv", "SELECT c_custkey::VARCHAR AS sample_id, c_mktsegment AS segment, round(c_acctbal, 2) AS acctbal FROM customer")
def phenotypes_csv(spark, sf):
    """Each customer twice: the first row counts."""
    c = table(spark, sf, "customer")
    first = c.select((F.col("c_custkey") * 2).alias("o"), F.concat_ws(",", F.col("c_custkey").cast("string"), "c_mktsegment", F.format_string("%.2f", "c_acctbal")).alias("value"))
    again = c.select((F.col("c_custkey") * 2 + 1).alias("o"), F.concat_ws(",", F.col("c_custkey").cast("string"), F.lit("LATER"), F.lit("0.00")).alias("value"))
    return rounded(tables.read_phenotypes(spark, _lines(first.unionByName(again), "phenotypes.csv", "sample_id,segment,acctbal")), "acctbal").withColumn("acctbal", F.round("acctbal", 2))


GENES = [f"GEN{i:02d}" for i in range(8)]


def _matrix(spark, sf, genes_in_rows: bool):
    """A matrix of suppliers and eight genes, in either orientation; one cell of a supplier is no number."""
    cell = lambda s, g: F.when((s + g) % 9 == 0, F.lit("NA")).otherwise(((s * 7 + g * 13) % 50).cast("string"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"))
    if not genes_in_rows:
        rows = s.select(F.col("s").alias("o"), F.concat_ws(",", F.concat(F.lit("sample-"), F.col("s").cast("string")), *[cell(F.col("s"), F.lit(g)) for g in range(8)]).alias("value"))
        return _lines(rows, "expression.csv", ",".join(["id", *GENES]))
    cells = s.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("g", F.struct("s", cell(F.col("s"), F.col("g")).alias("text")).alias("c"))
    lines = cells.groupBy("g").agg(F.array_sort(F.collect_list("c")).alias("c"))  # a row of the file: a cell a sample
    rows = lines.select(F.col("g").alias("o"), F.concat_ws(",", F.format_string("GEN%02d", F.col("g")), F.array_join("c.text", ",")).alias("value"))
    names = s.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda k: F.concat(F.lit("sample-"), k.cast("string"))), ",")).first()[0]
    return _lines(rows, "expression.csv", f"id,{names}")


EXPRESSION = "SELECT 'sample-' || s_suppkey AS sample_id, 'GEN0' || g AS gene, CASE WHEN (s_suppkey + g) % 9 = 0 THEN 0 ELSE (s_suppkey * 7 + g * 13) % 50 END::DOUBLE AS value FROM supplier, range(0, 8) t(g)"


@query("expression_matrix", EXPRESSION)
def expression_matrix(spark, sf):
    return tables.read_expression(spark, _matrix(spark, sf, False))


@query("expression_transposed", EXPRESSION)
def expression_transposed(spark, sf):
    """The same with genes in rows, which the labels tell; its columns are the samples."""
    return tables.read_expression(spark, _matrix(spark, sf, True))


@query(
    "expression_quality",
    f"""WITH e AS ({EXPRESSION}), s AS (SELECT sample_id, count(*) FILTER (value > 0) AS n FROM e GROUP BY 1), k AS (SELECT e.* FROM e JOIN s USING (sample_id) WHERE n >= 7)
 SELECT (SELECT count(*) FROM s) AS n_samples, (SELECT count(DISTINCT sample_id) FROM k) AS n_kept, (SELECT count(DISTINCT gene) FROM e) AS n_genes, round(100.0 * (SELECT count(*) FILTER (value = 0) FROM e) / (SELECT count(*) FROM e), 6)::DOUBLE AS pct_zero,
 (SELECT count(DISTINCT sample_id) FROM k) >= 2 AS usable""",
)
def expression_quality(spark, sf):
    from ..operators.expression import expression_report

    return rounded(expression_report(tables.read_expression(spark, _matrix(spark, sf, False)), min_genes=7), "pct_zero")


@query("components_csv", "SELECT c_custkey::VARCHAR AS sample_id, 'PC' || i AS pc, ((c_custkey * (3 + i)) % 17 / 4.0)::DOUBLE AS value FROM customer, range(1, 4) t(i)")
def components_csv(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    values = [((F.col("k") * (3 + i)) % 17 / 4.0).cast("string") for i in (1, 2, 3)]
    return tables.read_components(spark, _lines(c.select(F.col("k").alias("o"), F.concat_ws(",", F.col("k").cast("string"), *values).alias("value")), "pcs.csv", "sample,PC1,PC2,PC3"))


@query(
    "clinvar_tsv",
    """SELECT upper(p_brand) AS symbol, max(p_partkey) AS gene_id, max_by(p_size, p_partkey)::BIGINT AS n_pathogenic, max_by(p_size % 5, p_partkey)::BIGINT AS n_likely_pathogenic, 0::BIGINT AS n_uncertain, max_by(p_partkey % 7, p_partkey)::BIGINT AS n_benign, 0::BIGINT AS n_likely_benign FROM part GROUP BY 1""",
)
def clinvar_tsv(spark, sf):
    """A line a part: of those of one symbol the last counts."""
    p = table(spark, sf, "part")
    row = F.concat_ws("\t", "p_brand", *[c.cast("string") for c in (F.col("p_partkey"), F.col("p_size"), F.col("p_size") % 5, F.col("p_partkey") % 7)])
    rows = p.select(F.col("p_partkey").alias("o"), row.alias("value"))
    return tables.read_clinvar(spark, _lines(rows, "clinvar.tsv", "# made from parts\n#Symbol\tGeneID\tNumber_Pathogenic\tNumber_Likely_Pathogenic\tNumber_Benign"))


@query(
    "vep_tsv",
    """SELECT 'v' || p_partkey AS key, p_brand AS gene, p_type AS consequence, greatest(p_size, p_size % 7 + 20)::DOUBLE AS cadd FROM part""",
)
def vep_tsv(spark, sf):
    """Two lines a variant: the one with the higher CADD counts."""
    p = table(spark, sf, "part")
    line = lambda o, cadd: p.select((F.col("p_partkey") * 2 + o).alias("o"), F.concat_ws("\t", _cat("v", "@p_partkey"), "p_brand", F.concat("p_type", F.lit(",other")), cadd.cast("string")).alias("value"))
    rows = line(0, F.col("p_size")).unionByName(line(1, F.col("p_size") % 7 + 20))
    return annotations.read_vep(spark, _lines(rows, "vep.tsv", "## made from parts\n#Uploaded_variation\tSYMBOL\tConsequence\tCADD_PHRED"))


@query(
    "annovar_tsv",
    """SELECT '1:' || p_partkey || ':A:C' AS key, p_brand AS gene, CASE p_size % 3 WHEN 0 THEN 'missense_variant' WHEN 1 THEN 'synonymous_variant' ELSE 'frameshift_variant' END AS consequence, p_size::DOUBLE AS cadd FROM part""",
)
def annovar_tsv(spark, sf):
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "nonsynonymous SNV").when(F.col("p_size") % 3 == 1, "synonymous SNV").otherwise("frameshift deletion")
    k = F.col("p_partkey").cast("string")
    rows = p.select(F.col("p_partkey").alias("o"), F.concat_ws("\t", F.lit("1"), k, k, F.lit("A"), F.lit("C"), F.lit("exonic"), F.concat("p_brand", F.lit(";OTHER")), kind, F.col("p_size").cast("string")).alias("value"))
    return annotations.read_annovar(spark, _lines(rows, "annovar.tsv", "Chr\tStart\tEnd\tRef\tAlt\tFunc.refGene\tGene.refGene\tExonicFunc.refGene\tCADD_phred"))


@query(
    "annotation_statistics",
    with_tables(
        "variants",
        """SELECT count(*) AS n, count(*) FILTER (gene <> '') AS with_gene, count(*) FILTER (consequence <> '') AS with_consequence, count(*) FILTER (cadd > 0) AS with_cadd, count(DISTINCT gene) AS n_genes,
 count(*) FILTER (cadd > 0 AND cadd < 15) AS cadd_low, count(*) FILTER (cadd >= 15 AND cadd < 25) AS cadd_mid, count(*) FILTER (cadd >= 25) AS cadd_high FROM variants""",
    ),
)
def annotation_statistics(spark, sf):
    return annotations.annotation_statistics(A.variants(spark, sf))


@query("prior_run", with_tables("scores", "SELECT sample_id::VARCHAR AS sample_id, pathway, round(score, 9) AS score FROM scores"))
def prior_run(spark, sf):
    """Scores and assignments that a run wrote, read back for a comparison."""
    folder = _folder(spark, "run")
    tables.write_wide(A.scores(spark, sf), f"{folder}/pathway_scores.csv")
    assigned = A.groups(spark, sf).select("sample_id", F.substring("grp", 2, 1).cast("int").alias("cluster_id"))
    assigned.coalesce(1).write.option("header", True).csv(f"{folder}/subtype_assignments.csv")
    scores, labels = tables.read_scores(spark, folder)
    known = labels.select(F.col("sample_id").cast("string").alias("sample_id"))
    return scores.join(known, "sample_id", "left_semi").withColumn("score", F.round("score", 9))


@query(
    "safe_float_clean",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE p_size / 4.0 END::DOUBLE AS number, CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE '' END AS cleaned FROM part""",
)
def safe_float_clean(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, ".").when(k == 2, "n/a").otherwise((F.col("p_size") / 4.0).cast("string"))
    word = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, ".").otherwise(F.lit(None))
    return p.select("p_partkey", G.safe_double(text).alias("number"), G.clean_annotation(word).alias("cleaned"))


@query(
    "gene_symbols",
    """SELECT p_partkey, regexp_matches(s, '^[A-Z][A-Z0-9]{1,14}$') AS symbol FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) WHEN 2 THEN p_type || p_size ELSE p_brand END AS s FROM part)""",
)
def gene_symbols(spark, sf):
    k = F.col("p_partkey") % 4
    word = F.when(k == 0, F.col("p_type")).when(k == 1, F.lower("p_type")).when(k == 2, F.concat("p_type", F.col("p_size").cast("string"))).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", word.rlike(tables.SYMBOL).alias("symbol"))


@query("csv_sinks", with_tables("labelled", "SELECT sample_id, 'subtype_' || grp AS cluster_label, round(mod3_0, 9) AS mod3_0, round(mod3_1, 9) AS mod3_1 FROM (SELECT sample_id, any_value(grp) AS grp, max(score) FILTER (pathway = 'mod3_0') AS mod3_0, max(score) FILTER (pathway = 'mod3_1') AS mod3_1 FROM labelled GROUP BY 1)"))
def csv_sinks(spark, sf):
    """A wide table and assignments written as CSV with headers and read by column names."""
    folder = _folder(spark, "sinks")
    tables.write_wide(A.scores(spark, sf), f"{folder}/wide.csv")
    A.groups(spark, sf).select("sample_id", F.concat(F.lit("subtype_"), "grp").alias("cluster_label")).write.option("header", True).csv(f"{folder}/assignments.csv")
    wide = spark.read.csv(f"{folder}/wide.csv", header=True, inferSchema=True).select(F.col("sample_id").cast("long").alias("sample_id"), "mod3_0", "mod3_1")
    labels = spark.read.csv(f"{folder}/assignments.csv", header=True).select(F.col("sample_id").cast("long").alias("sample_id"), "cluster_label")
    return wide.join(labels, "sample_id").withColumns({c: F.round(c, 9) for c in ("mod3_0", "mod3_1")})


@query("config_fields", "SELECT * FROM (VALUES ('input_type', 'vcf'), ('n_clusters_range', '[2, 5]'), ('ancestry_n_pcs', '4'), ('validation_n_permutations', '100'), ('variant_qc_min_qual', '20.0'), ('seed', '7'), ('bad_method', 'refused'), ('bad_range', 'refused'), ('no_data', 'refused')) v(field, value)")
def config_fields(spark, sf):
    """A configuration becomes typed, with defaults; wrong ones are refused."""
    from .. import config as C

    good = {"pipeline": {"seed": 7}, "data": {"vcf_path": "x", "pathway_db": "y"}, "clustering": {"n_clusters_range": [2, 5]}, "ancestry": {"n_pcs": 4}, "variant_qc": {"min_qual": 20.0}}
    run = C.validate(good, check_files=False)
    rows = [(f, str(getattr(run, f))) for f in ("input_type", "n_clusters_range", "ancestry_n_pcs", "validation_n_permutations", "variant_qc_min_qual", "seed")]
    bad = {
        "bad_method": good | {"data": good["data"] | {"input_type": "expression", "expression_path": "z", "expression_scoring_method": "none"}},
        "bad_range": good | {"clustering": {"n_clusters_range": [5, 2]}}, "no_data": {"pipeline": {}},
    }
    for name, config in bad.items():
        try:
            C.validate(config, check_files=False)
            rows.append((name, "accepted"))
        except C.ConfigError:
            rows.append((name, "refused"))
    return spark.createDataFrame(rows, "field string, value string")


@query(
    "masked_calls_from_vcf",
    f"""WITH {SITES}{CALLS} SELECT 'S' || i AS sample_id, count(*) AS n, sum(CASE WHEN valid THEN (x = a)::INT + (y = a)::INT ELSE 0 END)::BIGINT AS dosage FROM calls GROUP BY 1""",
)
def masked_calls_from_vcf(spark, sf):
    """Depth 30 passes a bound of 20: nothing is masked."""
    g = qc.mask_genotypes(variants.read_vcf(spark, vcf_file(spark, sf)).genotypes.withColumn("gq", F.lit(99.0)), min_gq=20, min_dp=20)
    return g.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dosage").alias("dosage"))
