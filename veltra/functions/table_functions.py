"""Table functions for SQL: ``SELECT * FROM vcf_calls(TABLE(lines), samples => 'S1,S2', info => 'GENE string, CADD double')``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

# The names that a type of an INFO column may have.
KINDS = {"string": StringType(), "double": DoubleType(), "int": LongType()}


def _info_columns(text: str | None) -> list[tuple[str, str]]:
    """(key, kind) of "KEY kind, KEY kind"; a key alone is text."""
    out = []
    for part in filter(None, (x.strip() for x in (text or "").split(","))):
        key, _, kind = part.partition(" ")
        if kind.strip().lower() not in ("", *KINDS):
            raise ValueError(f"{part}: the kind of an INFO column is one of {', '.join(KINDS)}")
        out.append((key, kind.strip().lower() or "string"))
    return out


def _constant(argument: AnalyzeArgument | None, name: str) -> str | None:
    if argument is None:
        return None
    if not argument.isConstantExpression or argument.isTable:
        raise ValueError(f"{name} must be a constant")
    return argument.value


def _element(value: str | None, allele: int, alleles: int) -> str | None:
    """The allele's element of a list with one for each allele, else the first one."""
    if value is None:
        return None
    parts = value.split(",")
    return parts[allele - 1] if len(parts) == alleles else parts[0]


def _typed(value: str | None, kind: str) -> str | float | int | None:
    if value in (None, "", "."):
        return None
    if kind == "string":
        return value
    try:
        return float(value) if kind == "double" else int(value)
    except ValueError:
        return None


CALL = re.compile(r"(-?\d+)[/|](-?\d+)$")


class VcfCalls:
    """A row for each line, alternative allele and sample: chrom, pos, variant_id, ref, alt, allele, the INFO columns that
    are asked for, sample_id, dosage, valid. Its columns are known from the constants alone, before anything is read.

    lines: a table with a text column value. samples: names in the order of the file's columns. Headers, blank lines and
    lines under ten fields give no rows; an INFO value that isn't of its kind is null.
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument, samples: AnalyzeArgument, info: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not lines.isTable or "value" not in lines.dataType.names or not isinstance(lines.dataType["value"].dataType, StringType):
            raise ValueError("vcf_calls takes a table with a text column named value")
        if not _constant(samples, "samples"):
            raise ValueError("samples must name the columns of the file")
        schema = StructType().add("chrom", StringType()).add("pos", LongType()).add("variant_id", StringType()).add("ref", StringType()).add("alt", StringType()).add("allele", IntegerType())
        for key, kind in _info_columns(_constant(info, "info")):
            schema = schema.add(key.lower(), KINDS[kind])
        return AnalyzeResult(schema.add("sample_id", StringType()).add("dosage", IntegerType()).add("valid", BooleanType()))

    def eval(self, lines: Row, samples: str, info: str | None = None) -> Iterator[tuple]:
        line = lines["value"]
        if not line or line.startswith("#"):
            return
        f = line.rstrip("\r\n").split("\t")
        if len(f) < 10:
            return
        alts = f[4].split(",")
        said = {}
        for item in f[7].split(";") if f[7] != "." else []:
            key, eq, value = item.partition("=")
            said[key] = value if eq else "true"
        wanted = _info_columns(info)
        names, calls = samples.split(","), [CALL.match(c.split(":")[0]) for c in f[9:]]
        for a, alt in enumerate(alts, 1):
            name = "_".join([f[0], f[1], f[3], alt]) if f[2] in (".", "") else f"{f[2]}_{a}" if len(alts) > 1 else f[2]
            start = (f[0], int(f[1]) if f[1].isdigit() else None, name, f[3], alt, a, *(_typed(_element(said.get(k), a, len(alts)), kind) for k, kind in wanted))
            for sample, call in zip(names, calls, strict=False):
                yield (*start, sample, sum(int(x) == a for x in call.groups()) if call else 0, call is not None)


def register_table_functions(spark: SparkSession) -> None:
    """vcf_calls for SQL."""
    spark.udtf.register("vcf_calls", udtf(VcfCalls))
