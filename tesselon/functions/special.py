"""Tail probabilities in numpy, and the same as pandas UDFs.

Incomplete gamma and beta functions follow the usual series and continued-fraction
expansions; the normal tail is erfc.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def norm_sf(x):
    """P(Z > x)."""
    return 0.5 * _erfc(np.asarray(x, float) / math.sqrt(2))


def norm_ppf(q):
    """The normal quantile by Newton steps on norm_sf, from a logistic start."""
    q = np.asarray(q, float)
    inner = np.clip(q, 1e-300, 1 - 1e-16)
    x = np.sign(inner - 0.5) * np.sqrt(np.abs(-2 * np.log(np.minimum(inner, 1 - inner)))) * 0.8
    for _ in range(60):
        density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        x = x - np.clip(((1 - norm_sf(x)) - inner) / np.maximum(density, 1e-300), -1, 1)
    return np.where(q <= 0, -np.inf, np.where(q >= 1, np.inf, x))


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_two_sided(t, df):
    """P(|T| >= |t|) with df degrees of freedom; NaN where either is missing."""
    f = np.vectorize(lambda t, n: beta_i(n / 2, 0.5, n / (n + t * t)) if n > 0 and np.isfinite(t) else (0.0 if n > 0 and np.isinf(t) else np.nan), otypes=[float])
    return f(np.asarray(t, float), np.asarray(df, float))


def chi2_sf(x, df):
    return np.vectorize(lambda x, n: gamma_q(n / 2, x / 2) if n > 0 and np.isfinite(x) else np.nan, otypes=[float])(np.asarray(x, float), np.asarray(df, float))


def r_two_sided(r, n, covariates=0):
    """Two-sided p of a (partial) correlation r of n rows."""
    r, df = np.asarray(r, float), np.asarray(n, float) - 2 - covariates
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(np.abs(r) < 1, r * np.sqrt(np.maximum(df, 0) / (1 - r * r)), np.inf)
    return t_two_sided(np.where(np.isnan(r), np.nan, t), df)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(2 * norm_sf(z.abs().to_numpy(float))).where(z.notna().to_numpy())


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df))


@F.pandas_udf(DoubleType())
def r_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(r_two_sided(r, n))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x, df))
