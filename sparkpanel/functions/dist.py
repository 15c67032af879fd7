"""Student t and F tail probabilities for a handful of driver scalars.

SciPy is not available, so the regularised incomplete beta function is
evaluated with the classic continued-fraction expansion (Lentz's method).
"""

from __future__ import annotations

import math


def _betacf(a: float, b: float, x: float, max_iter: int = 500, eps: float = 1e-15) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value P(|T| > |t|) for T ~ t(df)."""
    if not math.isfinite(t):
        return 0.0 if not math.isnan(t) else float("nan")
    x = df / (df + t * t)
    return betainc(df / 2.0, 0.5, x)


def t_cdf(t: float, df: float) -> float:
    p = 0.5 * t_sf2(t, df)
    return 1.0 - p if t > 0 else p


def t_ppf(prob: float, df: float) -> float:
    """Quantile of t(df) by bisection on the CDF (driver scalar only)."""
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > prob:      # widen until the root is inside
        lo *= 2
    while t_cdf(hi, df) < prob:
        hi *= 2
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, df) < prob:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail P(F > f) for F ~ F(d1, d2)."""
    if f <= 0:
        return 1.0
    x = d2 / (d2 + d1 * f)
    return betainc(d2 / 2.0, d1 / 2.0, x)
