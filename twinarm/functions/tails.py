"""Tail probabilities and quantiles, vectorised over small result tables.

Spark has no incomplete beta or error function, so these run as Arrow UDFs. They
are applied only after aggregation, to one row per stratum.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_two_sided(z):
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2.0))


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta (modified Lentz), elementwise."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 4000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(x <= 0, 0.0, 1.0)
    inside = (x > 0) & (x < 1)
    if inside.any():
        a, b, x = a[inside], b[inside], x[inside]
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        swap = x > (a + 1) / (a + b + 2)
        aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        part = front * _beta_fraction(aa, bb, xx) / aa
        out = out.copy()
        out[inside] = np.where(swap, 1.0 - part, part)
    return out


def _log_gamma_step(a):
    """ln of Gamma(a + 1/2) / Gamma(a): its asymptotic series at a shifted argument, stepped back."""
    a = np.asarray(a, float)
    shifted, back = a + 0.0, np.zeros_like(a)
    for _ in range(24):
        small = shifted < 24
        back = back + np.where(small, np.log1p(0.5 / shifted), 0.0)
        shifted = np.where(small, shifted + 1, shifted)
    r = 1 / shifted
    series = r * (-1 / 8 + r * r * (1 / 192 + r * r * (-1 / 640 + r * r * (17 / 14336 - r * r * 31 / 18432))))
    return 0.5 * np.log(shifted) + series - back


_NODES = np.arange(-6, 6, 1 / 32)
_STEPS = np.exp(np.pi / 2 * np.sinh(_NODES))
_WEIGHTS = _STEPS * np.pi / 2 * np.cosh(_NODES) / 32


def _t_tail(t, df):
    """ln of the density at t, and the tail beyond t over that density."""
    tt, d = t[..., None], df[..., None]
    grown = np.log1p((2 * tt * _STEPS + _STEPS * _STEPS) / (d + tt * tt))
    beyond = (np.exp(-(d + 1) / 2 * grown) * _WEIGHTS).sum(-1)
    return _log_gamma_step(df / 2) - 0.5 * np.log(df * np.pi) - (df + 1) / 2 * np.log1p(t * t / df), beyond


def t_two_sided(t, df):
    """P(|T| >= |t|) for Student's t, by one quadrature of the density's tail for all degrees of freedom.

    The density beyond t is taken relative to its value at t, so small tails keep
    their relative precision.
    """
    t, df = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0) & np.isfinite(df)
    log_density, beyond = _t_tail(t[ok], df[ok])
    out[ok] = np.minimum(1.0, 2 * np.exp(log_density) * beyond)
    out[np.isinf(t) & (df > 0)] = 0.0
    return out


def normal_upper_point(tail):
    """z with upper tail probability ``tail``, by Newton steps on erfc."""
    tail = np.asarray(tail, float)
    r = np.sqrt(-2 * np.log(np.minimum(tail, 1 - tail)))
    z = r - (2.30753 + 0.27061 * r) / (1 + 0.99229 * r + 0.04481 * r * r)
    z = np.where(tail > 0.5, -z, z)
    for _ in range(8):
        gap = 0.5 * _erfc(z / math.sqrt(2)) - tail
        z = z + gap * math.sqrt(2 * math.pi) * np.exp(z * z / 2)
    return z


def t_point(level, df):
    """Half-width multiplier: t with two-sided probability ``1 - level``."""
    df = np.asarray(df, float)
    out = np.full(df.shape, np.nan)
    ok = df > 0
    if not ok.any():
        return out
    d = np.where(np.isfinite(df[ok]), df[ok], 1e15)
    tail = 1 - level
    z = normal_upper_point(tail / 2) * np.ones_like(d)
    low, high = z * 0.0, np.where(d < 1, 1e12, z * 1000.0)
    t = z * (1 + (z * z + 1) / (4 * d))
    for _ in range(200):
        log_density, beyond = _t_tail(t, d)
        # A step on the log of the tail, whose slope is the density over the tail.
        over = math.log(2) + log_density + np.log(beyond) - math.log(tail)
        low, high = np.where(over > 0, t, low), np.where(over > 0, high, t)
        step = t + over * beyond
        new = np.where((step > low) & (step < high), step, 0.5 * (low + high))
        if np.all(np.abs(new - t) <= 1e-13 * np.abs(t)):
            t = new
            break
        t = new
    out[ok] = t
    return out


def chi2_upper(x, df):
    """Upper tail of the chi-square with whole degrees of freedom, in closed form."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    out = np.full(x.shape, np.nan)
    for i in np.ndindex(x.shape):
        xi, k = x[i], df[i]
        if not (math.isfinite(k) and k >= 1) or math.isnan(xi):
            continue
        half, k = max(xi, 0.0) / 2, int(k)
        if half == 0:
            out[i] = 1.0
            continue
        total = math.erfc(math.sqrt(half)) if k % 2 else math.exp(-half)
        a = 0.5 if k % 2 else 1.0
        while a < k / 2:
            total += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
            a += 1
        out[i] = total
    return out


def _udf(fn, n_args: int):
    if n_args == 1:
        def run(a: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(dtype=float, na_value=np.nan))).replace({np.nan: None}).astype(object)
    else:
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            values = fn(a.to_numpy(dtype=float, na_value=np.nan), b.to_numpy(dtype=float, na_value=np.nan))
            return pd.Series(values).replace({np.nan: None}).astype(object)
    return F.pandas_udf(run, "double")


def normal_p(z: Column) -> Column:
    """Two-sided normal p-value."""
    return _udf(normal_two_sided, 1)(z.cast("double"))


def t_p(t: Column, df: Column) -> Column:
    """Two-sided t p-value."""
    return _udf(t_two_sided, 2)(t.cast("double"), df.cast("double"))


def t_multiplier(df: Column, level: float = 0.95) -> Column:
    """Critical t value for a confidence level."""
    return _udf(lambda d: t_point(level, d), 1)(df.cast("double"))


def chi2_p(x: Column, df: Column) -> Column:
    """Upper chi-square p-value."""
    return _udf(chi2_upper, 2)(x.cast("double"), df.cast("double"))
