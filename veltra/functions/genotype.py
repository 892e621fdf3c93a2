"""Column builders for genotype strings, INFO strings and annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def genotype(gt: Column, target: Column | int = 1) -> Column:
    """struct(dosage, valid): copies of the target allele in a diploid genotype; anything else is invalid with dosage 0."""
    call = F.split(gt, ":")[0]
    alleles = F.split(call, r"[/|]")
    valid = F.coalesce((F.size(alleles) == 2) & F.forall(alleles, lambda a: a.rlike(r"^-?\d+$")), F.lit(False))
    want = F.lit(target) if isinstance(target, int) else target
    dosage = F.size(F.filter(alleles, lambda a: a.try_cast("int") == want))
    return F.struct(F.when(valid, dosage).otherwise(F.lit(0)).alias("dosage"), valid.alias("valid"))


def info_map(info: Column) -> Column:
    """map of INFO keys to text: a flag is "true", "." is null; null, empty and "." give an empty map, later keys win."""
    items = F.filter(F.split(info, ";"), lambda x: x != "")

    def entry(item: Column) -> Column:
        at = F.instr(item, "=")
        key = F.when(at > 0, F.substring(item, F.lit(1), at - 1)).otherwise(item)
        value = F.when(at == 0, F.lit("true")).otherwise(F.substring(item, at + 1, F.length(item)))
        return F.named_struct(F.lit("key"), key, F.lit("value"), F.nullif(value, F.lit(".")))

    entries = F.transform(items, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    empty = F.create_map().cast("map<string,string>")
    return F.when(info.isNull() | info.isin("", "."), empty).otherwise(F.map_from_entries(last))


def info_value(info: Column, key: str) -> Column:
    return F.try_element_at(info_map(info), F.lit(key))


def allele_value(value: Column, allele: Column, alleles: Column) -> Column:
    """The allele's element of a comma list with one element for each allele; else the first element."""
    parts = F.split(value, ",")
    return F.when(F.size(parts) == alleles, F.get(parts, allele - 1)).otherwise(parts[0])


def clean_annotation(value: Column) -> Column:
    """Empty for null, "." and flags; the first element of a list."""
    return F.when(value.isNull() | value.isin(".", "true"), F.lit("")).otherwise(F.split(value, ",")[0])


def safe_double(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default).cast("double"))
