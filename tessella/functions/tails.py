"""Upper tails of F and of the studentised range, for tables of a few rows."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out / a


def f_tail(f: float, df1: float, df2: float) -> float:
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in np.ravel(z)]).reshape(np.shape(z)))


def tukey_tail(q: float, groups: int, df: float) -> float:
    """P(studentised range of ``groups`` means with ``df`` degrees of freedom > q), by quadrature."""
    if q <= 0:
        return 1.0
    z, wz = np.polynomial.legendre.leggauss(64)
    z, wz = 8 * z, 8 * wz
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    s, ws = np.polynomial.legendre.leggauss(48)
    spread = 6 / math.sqrt(2 * df)
    low, high = max(0.0, 1 - spread), 1 + spread
    s, ws = (high - low) / 2 * s + (high + low) / 2, (high - low) / 2 * ws
    log_s = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    inside = [groups * float(np.sum(wz * density * (_normal_cdf(z) - _normal_cdf(z - q * v)) ** (groups - 1))) for v in s]
    return float(min(1.0, max(0.0, 1 - np.sum(ws * np.exp(log_s) * np.array(inside)))))
