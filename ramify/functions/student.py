"""Student's t distribution, by the continued fraction of the incomplete beta function."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def two_sided(t: float, df: float) -> float:
    """The probability of a value at least as far from zero as t."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def quantile(p: float, df: float) -> float:
    """The t below which the share p lies, by bisection."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -quantile(1 - p, df)
    low, high = 0.0, 1.0
    while two_sided(high, df) > 2 * (1 - p):
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if two_sided(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: Column) -> Column:
    @pandas_udf("double")
    def run(d: pd.Series) -> pd.Series:
        return d.map(lambda x: quantile(p, x), na_action="ignore").astype(float)

    return run(df)


def t_p_value(t: Column, df: Column) -> Column:
    @pandas_udf("double")
    def run(a: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else two_sided(x, y) for x, y in zip(a, d, strict=True)], dtype=float)

    return run(t, df)
