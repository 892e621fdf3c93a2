"""Tails of the chi-square and F distributions, in NumPy and as Arrow UDFs; closed forms as expressions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: a series below a + 1, else a continued fraction (Lentz)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def _beta_i(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def chi2_tail(x: float, df: float) -> float:
    return _gamma_q(df / 2, x / 2) if df > 0 and x == x else math.nan


def f_tail(x: float, df1: float, df2: float) -> float:
    if not (x == x and df1 > 0 and df2 > 0):
        return math.nan
    return _beta_i(df2 / 2, df1 / 2, df2 / (df2 + df1 * x)) if x > 0 else 1.0


@lru_cache(maxsize=None)
def _udf(tail, arguments: int):
    """An Arrow UDF of a scalar tail; made at the first use, as it needs a session."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([tail(*v) for v in zip(*(c.astype(float) for c in columns), strict=True)], dtype="float64")

    def two(x: pd.Series, a: pd.Series) -> pd.Series:
        return run(x, a)

    def three(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return run(x, a, b)

    return F.pandas_udf(two if arguments == 2 else three, "double")


def chi2_sf(x: Column, df: Column) -> Column:
    return _udf(chi2_tail, 2)(x, df)


def f_sf(x: Column, df1: Column, df2: Column) -> Column:
    return _udf(f_tail, 3)(x, df1, df2)


def chi2_sf_even(x: Column, df: int) -> Column:
    """Closed form for even degrees of freedom."""
    if df < 2 or df % 2:
        raise ValueError("an even number of degrees of freedom is needed")
    half, term, total = x / F.lit(2.0), F.lit(1.0).cast("double"), F.lit(1.0).cast("double")
    for i in range(1, df // 2):
        term = term * half / F.lit(float(i))
        total = total + term
    return F.exp(-half) * total


def adjusted_rand(a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None) -> float:
    """Adjusted Rand index of two labelings; 1 where it is 0/0. w: how many elements each place stands for."""
    _, x = np.unique(a, return_inverse=True)
    _, y = np.unique(b, return_inverse=True)
    table = np.zeros((x.max(initial=0) + 1, y.max(initial=0) + 1))
    np.add.at(table, (x, y), 1 if w is None else w)
    return adjusted_rand_of(table)


def adjusted_rand_of(table: np.ndarray) -> float:
    """The index of a contingency table."""
    pairs = lambda v: (v * (v - 1) / 2).sum()
    both, rows, cols, n = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), pairs(table.sum())
    expected, most = rows * cols / n if n else 0.0, (rows + cols) / 2
    return 1.0 if most == expected else float((both - expected) / (most - expected))


def register_functions(spark) -> None:
    """chi2_sf, f_sf and the grouped aggregate ari for SQL. A group of ari must fit a task; operators.agreement has no such limit."""

    def ari(a: pd.Series, b: pd.Series) -> float:
        return adjusted_rand(a.to_numpy(), b.to_numpy())

    spark.udf.register("chi2_sf", _udf(chi2_tail, 2))
    spark.udf.register("f_sf", _udf(f_tail, 3))
    spark.udf.register("ari", F.pandas_udf(ari, "double"))
