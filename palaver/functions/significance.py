"""Two-sided p-value of a correlation coefficient, for the single row of a fit."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"no convergence at a={a}, b={b}, x={x}")


def _log_gamma_ratio(a: float, b: float) -> float:
    """log of gamma(a + b) / gamma(a); for large a and b = 1/2 by its series, free of cancellation."""
    if b == 0.5 and a > 1e4:
        return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3)
    return math.lgamma(a + b) - math.lgamma(a)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(_log_gamma_ratio(a, b) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def p_value(r: float | None, n: int | None) -> float | None:
    """Chance of a correlation at least this strong among ``n`` unrelated pairs (t test, n-2 df)."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    df = n - 2
    t = abs(r) * math.sqrt(df / (1.0 - r * r)) if abs(r) < 1.0 else math.inf
    if df > 1_000_000 and t**4 < 1e-5 * df:
        # Student's t near the normal distribution: the first term in 1/df leaves an error below 1e-10.
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        return math.erfc(t / math.sqrt(2)) + density * (t**3 + t) / (2 * df)
    return incomplete_beta(df / 2.0, 0.5, max(0.0, 1.0 - r * r))


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(
        [p_value(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b)) for a, b in zip(r, n)],
        dtype="float64",
    )
