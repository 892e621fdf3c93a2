"""Batch correction of long scores: batched (sample_id, batch, pathway, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import d
from ..session import few
from .inference import anova


def _stats(batched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows by pathway (grand, total_sd) and by pathway and batch (n, mean, sd): summaries that are joined back."""
    whole = batched.groupBy("pathway").agg(F.avg("score").alias("grand"), F.stddev_samp("score").alias("total_sd"))
    parts = batched.groupBy("pathway", "batch").agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd")
    )
    return whole, parts


def _joined(batched: DataFrame, parts: DataFrame) -> DataFrame:
    return batched.join(few(parts), ["pathway", "batch"])


def _out(df: DataFrame, score) -> DataFrame:
    return df.select("sample_id", "batch", "pathway", score.alias("score"))


def mean_center(batched: DataFrame) -> DataFrame:
    whole, parts = _stats(batched)
    return _out(_joined(batched, parts.join(whole, "pathway")), F.col("score") - F.col("mean") + F.col("grand"))


def standardize(batched: DataFrame) -> DataFrame:
    """z in the batch, on the scale of all; a batch without spread gets the grand mean."""
    whole, parts = _stats(batched)
    j = _joined(batched, parts.join(whole, "pathway"))
    z = (F.col("score") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(d(1))
    return _out(j, z * F.col("total_sd") + F.col("grand"))


def combat(batched: DataFrame) -> DataFrame:
    """Location and scale of each batch, shrunk by empirical Bayes; all in closed form over a row for each batch."""
    whole, parts = _stats(batched)
    p = parts.join(whole, "pathway").withColumn("scale", F.when(F.col("total_sd") > 0, F.col("total_sd")).otherwise(d(1)))
    gamma, delta = (F.col("mean") - F.col("grand")) / F.col("scale"), F.pow(F.col("sd") / F.col("scale"), 2)
    p = p.withColumn("gamma", gamma).withColumn("delta", delta)
    prior = p.groupBy("pathway").agg(F.avg("gamma").alias("gbar"), F.var_samp("gamma").alias("tau2"), F.avg("delta").alias("dbar"))
    p = p.join(prior, "pathway")
    noise = F.greatest(F.col("delta"), d(1e-10)) / F.col("n")
    weight = F.coalesce(F.try_divide(F.col("tau2"), F.col("tau2") + noise), d(0.5))
    shrink = F.least(d(0.5), d(2) / F.col("n"))
    root = F.sqrt((1 - shrink) * F.col("delta") + shrink * F.col("dbar"))
    p = p.withColumn("gstar", weight * F.col("gamma") + (1 - weight) * F.col("gbar"))
    p = p.withColumn("dstar", F.when(root < 1e-10, d(1)).otherwise(root))
    p = p.select("pathway", "batch", "grand", "scale", "gstar", "dstar")
    z = (F.col("score") - F.col("grand")) / F.col("scale")
    return _out(_joined(batched, p), (z - F.col("gstar")) / F.col("dstar") * F.col("scale") + F.col("grand"))


METHODS = {"combat": combat, "mean_center": mean_center, "standardize": standardize}


def correct(batched: DataFrame, method: str = "combat") -> DataFrame:
    return METHODS[method](batched)


def batch_effects(batched: DataFrame, alpha: float = 0.05) -> DataFrame:
    """pathway, f_stat, p, q (without the monotone step), eta2 and significant."""
    from ..functions.distributions import f_sf
    from .inference import benjamini_hochberg

    tests = anova(batched.withColumnRenamed("batch", "grp"))
    p = F.coalesce(f_sf(F.col("f_stat"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")), d(1))
    tests = tests.select("pathway", "f_stat", F.when(F.isnan(p), d(1)).otherwise(p).alias("p"), "eta2")
    return benjamini_hochberg(tests, monotone=False).withColumn("significant", F.col("q") < alpha)


def validate(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """pathway, eta2 before and after, r between the two."""
    eta = lambda df, name: anova(df.withColumnRenamed("batch", "grp")).select("pathway", F.col("eta2").alias(name))
    both = original.select("sample_id", "pathway", "score").join(
        corrected.select("sample_id", "pathway", F.col("score").alias("new")), ["sample_id", "pathway"]
    )
    r = both.groupBy("pathway").agg(F.corr("score", "new").alias("r"))
    return eta(original, "eta2_before").join(eta(corrected, "eta2_after"), "pathway").join(r, "pathway")
