"""Tail probabilities and scores made of them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
    value = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: np.ndarray, df: float) -> np.ndarray:
    """Two-sided p of Student's t."""
    return np.array([incomplete_beta(df / 2, 0.5, df / (df + v * v)) if np.isfinite(v) else np.nan for v in np.atleast_1d(t)])


def signed_log_p(estimate: Column, p: Column) -> Column:
    """-log10 of the one-sided p in the direction of the estimate, negative below 0."""
    one = F.greatest(p / 2, F.lit(1e-300))
    return F.when(estimate >= 0, -F.log10(one)).otherwise(F.log10(one))
