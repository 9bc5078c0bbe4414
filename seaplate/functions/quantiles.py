"""Quantiles and masses that Spark has no expression for, as Arrow column functions.

Each function solves once per distinct parameter of a batch; the rows themselves
stay partitioned by Spark. Every loop ends by its own arithmetic: bisections have a
bounded interval, and series run until a term no longer counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from seaplate.functions.numeric import upper_normal_array
from seaplate.vocab import HIGH_TAIL, LOW_TAIL

TAILS = StructType([StructField("low", DoubleType()), StructField("high", DoubleType())])
LEGENDRE_NODES, LEGENDRE_WEIGHTS = np.polynomial.legendre.leggauss(64)
BISECTIONS = 64
# From here on expansions in the reciprocal parameter are exact to more than ten digits.
MANY_DEGREES = 400.0
LARGE_SHAPE = 500.0


def normal_quantile(p: float) -> float:
    """z with P(Z <= z) = p, by bisection."""
    low, high = -40.0, 40.0
    for _ in range(2 * BISECTIONS):
        mid = (low + high) / 2
        low, high = (low, mid) if 0.5 * math.erfc(-mid / math.sqrt(2)) >= p else (mid, high)
    return (low + high) / 2


def student_cdf_angle(angle: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T <= sqrt(df) tan(angle)) for angles from 0 on, by Gauss-Legendre quadrature in the angle."""
    a = angle[:, None] * (LEGENDRE_NODES + 1) / 2
    log_norm = np.array([math.lgamma((d + 1) / 2) - math.lgamma(d / 2) for d in df]) - math.log(math.pi) / 2
    density = np.exp(log_norm[:, None] + (df[:, None] - 1) * np.log(np.cos(a)))
    return 0.5 + (density * LEGENDRE_WEIGHTS).sum(axis=1) * angle / 2


def _student_expanded(p: float, df: np.ndarray) -> np.ndarray:
    """The quantile as the normal one plus corrections in powers of 1/df."""
    z, d = normal_quantile(p), 1 / df
    z2 = z * z
    return z * (
        1
        + d * (z2 + 1) / 4
        + d**2 * (5 * z2**2 + 16 * z2 + 3) / 96
        + d**3 * (3 * z2**3 + 19 * z2**2 + 17 * z2 - 15) / 384
        + d**4 * (79 * z2**4 + 776 * z2**3 + 1482 * z2**2 - 1920 * z2 - 945) / 92160
    )


def student_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """Quantile of Student's t for p > 0.5: bisection on the angle, or an expansion for many degrees of freedom."""
    out = np.empty_like(df)
    many = df >= MANY_DEGREES
    out[many] = _student_expanded(p, df[many])
    few = df[~many]
    low, high = np.zeros_like(few), np.full_like(few, math.pi / 2)
    for _ in range(BISECTIONS):
        mid = (low + high) / 2
        below = student_cdf_angle(mid, few) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    out[~many] = np.sqrt(few) * np.tan((low + high) / 2)
    return out


def t_quantile(p: float):
    """Column function: t quantile at ``p`` for a column of degrees of freedom (< 1 gives NULL)."""

    @F.pandas_udf(DoubleType())
    def quantile(df: pd.Series) -> pd.Series:
        result = np.full(len(df), np.nan)
        valid = usable(df)
        distinct, where = np.unique(df[valid].to_numpy(dtype="float64"), return_inverse=True)
        if len(distinct):
            result[valid] = student_quantile(p, distinct)[where]
        return pd.Series(result)

    return quantile


def log_gamma(a: np.ndarray) -> np.ndarray:
    distinct, where = np.unique(a, return_inverse=True)
    return np.array([math.lgamma(v) for v in distinct])[where].reshape(a.shape)


def gamma_log_quantile(p: float, shape: np.ndarray) -> np.ndarray:
    """log of the unit-rate gamma quantile, by bisection on the log scale."""
    low = (math.log(p) + log_gamma(shape + 1)) / shape  # the mass is at most x**shape / gamma(shape + 1)
    high = np.maximum(np.log(shape + 12 * np.sqrt(shape) + 40), low)
    for _ in range(BISECTIONS + 16):
        mid = (low + high) / 2
        below = gamma_mass(shape, mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def gamma_mass(shape: np.ndarray, log_x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(shape, x): ascending series below the mean, continued fraction above it,
    uniform expansion for large shapes."""
    shape, log_x = np.broadcast_arrays(np.asarray(shape, float), np.asarray(log_x, float))
    out = np.empty(shape.shape)
    large = shape >= LARGE_SHAPE
    below = ~large & (log_x <= np.log(shape + 1))
    above = ~large & ~below
    for mask, mass in ((large, _mass_expanded), (below, _mass_series), (above, _mass_fraction)):
        if mask.any():
            out[mask] = mass(shape[mask], log_x[mask])
    return out


def _mass_series(a: np.ndarray, log_x: np.ndarray) -> np.ndarray:
    x = np.exp(log_x)
    term = np.ones_like(x)
    total = np.ones_like(x)
    n = 0
    while np.any(term > total * 1e-17):  # x <= a + 1, so terms fall from the first on
        n += 1
        term = term * x / (a + n)
        total = total + term
    return np.exp(a * log_x - x - log_gamma(a + 1)) * total


def _mass_fraction(a: np.ndarray, log_x: np.ndarray) -> np.ndarray:
    x = np.exp(np.minimum(log_x, 700.0))
    b = x + 1 - a
    c = np.full_like(x, 1e300)
    d = 1 / b
    h = d
    i, change = 0, np.full_like(x, 2.0)
    while np.any(np.abs(change - 1) > 1e-15):  # x > a + 1, where the fraction closes in on its value from both sides
        i += 1
        an = i * (a - i)
        b = b + 2
        d = 1 / (an * d + b)
        c = b + an / c
        change = c * d
        h = h * change
        if i % 16 == 0:
            change = np.where(h < 1e-290, 1.0, change)
    return 1 - np.exp(a * log_x - x - log_gamma(a)) * h


def _mass_expanded(a: np.ndarray, log_x: np.ndarray) -> np.ndarray:
    """Temme's expansion around the mean with its first correction; the next one is below 1e-7 of the density here."""
    u = np.clip(log_x - np.log(a), -50.0, 50.0)
    small = np.abs(u) < 0.05
    powers = np.where(small, u, 0.0)
    series = sum(powers**k / math.factorial(k) for k in range(2, 11))
    half = np.where(small, series, np.expm1(u) - u)
    eta = np.sign(u) * np.sqrt(2 * half)
    mu = np.expm1(u)
    close = np.abs(eta) < 1e-3
    first = -1 / 3 + eta / 12 - 2 * eta**2 / 135
    correction = np.where(close, first, 1 / np.where(close, 1.0, mu) - 1 / np.where(close, 1.0, eta))
    return upper_normal_array(-eta * np.sqrt(a)) - np.exp(-a * half) / np.sqrt(2 * math.pi * a) * correction


@F.pandas_udf(TAILS)
def gamma_tails(shape: pd.Series) -> pd.DataFrame:
    """Unit-rate gamma quantiles at the two tails; NULL for an unusable shape."""
    tails = np.full((len(shape), 2), np.nan)
    valid = usable(shape)
    distinct, where = np.unique(shape[valid].to_numpy(dtype="float64"), return_inverse=True)
    if len(distinct):
        solved = np.exp(np.stack([gamma_log_quantile(p, distinct) for p in (LOW_TAIL, HIGH_TAIL)], axis=1))
        tails[valid] = solved[where]
    return pd.DataFrame(tails, columns=["low", "high"])


def usable(parameter: pd.Series) -> np.ndarray:
    value = parameter.to_numpy(dtype="float64")
    return np.isfinite(value) & (np.nan_to_num(value) > 0)
