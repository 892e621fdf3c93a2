"""Variant weights: the pipeline's own, and the published schemes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lof, missense high/moderate/low, other, CADD high/moderate/low, CADD cap.
FIELDS = ("lof", "high", "moderate", "low", "other", "cadd_high", "cadd_moderate", "cadd_low", "cap")
SCHEMES = {
    "default": (1.0, 0.5, 0.1, 0.1, 0.1, 25.0, 25.0, 15.0, 40.0),
    "gnomad_constraint": (1.0, 0.8, 0.4, 0.1, 0.05, 25.0, 20.0, 15.0, 40.0),
    "acmg_inspired": (1.0, 0.9, 0.5, 0.1, 0.05, 30.0, 25.0, 20.0, 40.0),
    "cadd_percentile": (1.0, 0.7, 0.4, 0.2, 0.1, 25.0, 20.0, 15.0, 40.0),
    "uniform": (1.0, 1.0, 1.0, 1.0, 1.0, 25.0, 20.0, 15.0, 40.0),
}
# Terms of a loss of function in the schemes.
LOF_TERMS = "frameshift stop_gained stop_lost splice_donor splice_acceptor start_lost transcript_ablation".split()
# Terms of an annotation tool and the consequence of each, the first that occurs counts.
ANNOVAR_TERMS = {
    "nonframeshift insertion": "inframe_insertion",
    "nonframeshift deletion": "inframe_deletion",
    "frameshift insertion": "frameshift_variant",
    "frameshift deletion": "frameshift_variant",
    "frameshift block substitution": "frameshift_variant",
    "frameshift_variant": "frameshift_variant",
    "stopgain": "stop_gained",
    "stop_gained": "stop_gained",
    "stoploss": "stop_lost",
    "stop_lost": "stop_lost",
    "nonsynonymous snv": "missense_variant",
    "missense_variant": "missense_variant",
    "synonymous snv": "synonymous_variant",
    "synonymous_variant": "synonymous_variant",
    "splicing": "splice_acceptor_variant",
    "splice_acceptor_variant": "splice_acceptor_variant",
    "splice_donor_variant": "splice_donor_variant",
    "inframe_insertion": "inframe_insertion",
    "inframe_deletion": "inframe_deletion",
    "startloss": "start_lost",
    "start_lost": "start_lost",
}


def d(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def contains_any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms))


def pipeline_weight(consequence: Column, cadd: Column) -> Column:
    """Class weight times the capped CADD share; a CADD of 0 or less is the default of its class."""
    text = F.lower(consequence)
    lof, missense = contains_any(text, ["frameshift", "stop"]), text.contains("missense")
    weight = F.when(lof, d(1)).when(missense & (cadd > 25), d(0.5)).otherwise(d(0.1))
    default = F.when(lof, d(35)).when(missense, d(20)).otherwise(d(10))
    score = F.when(cadd > 0, cadd).otherwise(default)
    return weight * (F.least(score, d(40)) / d(40))


def scheme_weight(consequence: Column, cadd: Column, scheme: str) -> Column:
    """The class weight of a scheme; CADD thresholds are inclusive, below the lowest a missense counts half."""
    w = dict(zip(FIELDS, SCHEMES[scheme], strict=True))
    text = F.lower(consequence)
    missense = (
        F.when(cadd >= w["cadd_high"], d(w["high"]))
        .when(cadd >= w["cadd_moderate"], d(w["moderate"]))
        .when(cadd >= w["cadd_low"], d(w["low"]))
        .otherwise(d(w["low"] * 0.5))
    )
    inframe = F.when(cadd >= w["cadd_high"], d(w["moderate"])).otherwise(d(w["other"]))
    return (
        F.when(contains_any(text, LOF_TERMS), d(w["lof"]))
        .when(text.contains("missense"), missense)
        .when(text.contains("inframe"), inframe)
        .otherwise(d(w["other"]))
    )


def annovar_consequence(function: Column, frameshift_first: bool = False) -> Column:
    """frameshift_first: the known quirk that nonframeshift terms count as frameshift, for old outputs."""
    terms = dict(ANNOVAR_TERMS)
    if frameshift_first:
        terms = {k: v for k, v in terms.items() if k.startswith("frame")} | terms
    text, out = F.lower(function), None
    for term, value in terms.items():
        out = F.when(text.contains(term), F.lit(value)) if out is None else out.when(text.contains(term), F.lit(value))
    return F.when(F.coalesce(function, F.lit("")) == "", F.lit("unknown")).otherwise(out.otherwise(F.lit("unknown")))


def subtype_label(pathway: Column, cluster: Column) -> Column:
    """A name from the words in the top pathway's name, the first that matches."""
    # Words and labels.
    words = [
        (["SYNAPTIC", "GLUTAMAT"], "synaptic"),
        (["CHROMATIN", "HISTONE"], "chromatin"),
        (["ION_CHANNEL", "SODIUM", "POTASSIUM"], "ion_channel"),
        (["DOPAMINE"], "dopamine"),
        (["GABA"], "gaba"),
        (["IMMUNE", "COMPLEMENT"], "immune"),
        (["MTOR", "PI3K"], "mtor"),
    ]
    text, out = F.upper(pathway), None
    for terms, label in words:
        hit = contains_any(text, terms)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.concat(F.lit("subtype_"), cluster.cast("string")))
