"""Gene sets in GMT files: name, description, genes, by tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import numbered_lines, ordered_lines


class GmtError(ValueError):
    pass


def parse_gmt(lines: DataFrame) -> DataFrame:
    """lines (value) -> pathway, gene, ord. Blank lines, comments and lines under three fields are skipped."""
    f = lines.where("trim(value) != '' and not startswith(ltrim(value), '#')").select(F.split(F.rtrim("value"), "\t").alias("f")).where("size(f) >= 3")
    return f.select(F.col("f")[0].alias("pathway"), F.posexplode(F.slice("f", F.lit(3), F.size("f") - 2)).alias("ord", "gene"))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """pathway, gene, ord; of sets with one name the last in the file counts, wherever the file is split."""
    lines = ordered_lines(spark, path)
    kept = lines.where("trim(value) != '' and not startswith(ltrim(value), '#') and size(split(value, '\t')) >= 3")
    return parse_gmt(kept.groupBy(F.split("value", "\t")[0]).agg(F.max_by("value", "line").alias("value")))


def validate_gmt(spark: SparkSession, path: str) -> DataFrame:
    """Like read_gmt, strictly: raises GmtError with the first five problems."""
    lines = numbered_lines(spark, path).where("trim(value) != '' and not startswith(ltrim(value), '#')")
    f = F.split("value", "\t")
    genes = F.filter(F.transform(F.slice(f, F.lit(3), F.greatest(F.lit(0), F.size(f) - 2)), lambda g: F.trim(g)), lambda g: g != "")
    rows = lines.select("line", f.alias("f"), F.trim(f[0]).alias("name"), F.when(F.size(f) >= 3, genes).otherwise(F.array().cast("array<string>")).alias("genes"))
    repeated = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1
    problem = (
        F.when(F.size("f") < 3, "fewer than 3 fields").when(F.col("name") == "", "empty name").when(F.size("genes") < 2, "fewer than 2 genes").when(repeated, "duplicate name")
    )
    judged = rows.withColumn("problem", problem)
    bad = judged.where("problem is not null").orderBy("line").limit(5).collect()
    if bad:
        raise GmtError("; ".join(f"line {r['line'] + 1}: {r['problem']}" for r in bad))
    if not judged.limit(1).count():
        raise GmtError("no gene set")
    return judged.select(F.col("name").alias("pathway"), F.posexplode("genes").alias("ord", "gene"))


# Species and the prefixes of their stable ids.
SPECIES = {
    "Homo sapiens": "R-HSA-",
    "Mus musculus": "R-MMU-",
    "Rattus norvegicus": "R-RNO-",
    "Danio rerio": "R-DRE-",
    "Drosophila melanogaster": "R-DME-",
}


def read_reactome(spark: SparkSession, path: str, species: str = "Homo sapiens") -> DataFrame:
    """pathway, gene, ord of sets whose description names the species or whose name or description has its prefix."""
    prefix, f = SPECIES.get(species, "\0"), F.split("value", "\t")
    hit = F.lower(f[1]).contains(species.lower()) | f[0].startswith(prefix) | f[1].startswith(prefix)
    return parse_gmt(spark.read.text(path).where("size(split(value, '\t')) >= 3").where(hit))
