"""Student t tail and quantile for the few rows of a fit summary."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Send these functions along with the plan: workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: From here on the tail is taken from the normal one with two corrections, whose error is below 1e-14.
LARGE_DF = 1e5


def _log_gamma_ratio(a: float) -> float:
    """log gamma(a + 1/2) - log gamma(a), without taking a small difference of large numbers."""
    if a < 30:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function where one of a, b is 1/2, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    tiny = 1e-300
    ratio = _log_gamma_ratio(max(a, b)) - math.lgamma(0.5)
    scale = math.exp(ratio + a * math.log(x) + b * math.log1p(-x))
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    fraction, m, step = d, 0, 0.0
    while abs(step - 1) >= 1e-15:
        m += 1
        if m > 1_000_000:
            raise ArithmeticError(f"no convergence for a = {a}, b = {b}, x = {x}")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            step = c * d
            fraction *= step
    return scale * fraction / a


def two_sided_p(t: float, df: float) -> float:
    """P(|T| > |t|) with df degrees of freedom."""
    if df < LARGE_DF:
        return _incomplete_beta(df / 2, 0.5, df / (df + t * t))
    t = abs(t)
    if t > 40:
        return 0.0
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    first = (t**3 + t) / (4 * df)
    second = (3 * t**7 - 7 * t**5 - 5 * t**3 - 3 * t) / (96 * df * df)
    return math.erfc(t / math.sqrt(2)) + 2 * density * (first + second)


def critical_t(level: float, df: float) -> float:
    """t with P(|T| <= t) = level, by bisection."""
    low, high = 0.0, 1.0
    while two_sided_p(high, df) > 1 - level:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if two_sided_p(middle, df) > 1 - level else (low, middle)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def two_sided_p_of(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) or pd.isna(b) or b <= 0 else two_sided_p(a, b) for a, b in zip(t, df)],
        dtype="float64",
    )


@F.pandas_udf(DoubleType())
def critical_t_of(level: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(b) or b <= 0 else critical_t(a, b) for a, b in zip(level, df)],
        dtype="float64",
    )
