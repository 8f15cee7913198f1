"""Distribution functions used on aggregated scalars: normal, t, chi-square and F."""

from __future__ import annotations

import math


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def norm_ppf(p: float) -> float:
    if not 0 < p < 1:
        return math.inf if p == 1 else -math.inf if p == 0 else math.nan
    return _solve(norm_cdf, p, -40.0, 40.0)


def _solve(cdf, p: float, lo: float, hi: float) -> float:
    """Bisection, exact to the last bits: the functions here are called on a few scalars only."""
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return 0.5 * (lo + hi)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return front * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def t_cdf(t: float, df: float) -> float:
    if math.isinf(df):
        return norm_cdf(t)
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t < 0 else 1 - tail


def t_ppf(p: float, df: float) -> float:
    if math.isinf(df):
        return norm_ppf(p)
    return _solve(lambda x: t_cdf(x, df), p, -1e6, 1e6) if 0 < p < 1 else math.nan


def chi2_sf(x: float, df: float) -> float:
    return math.nan if math.isnan(x) else 1 - gamma_inc(df / 2, x / 2)


def chi2_ppf(p: float, df: float) -> float:
    return _solve(lambda x: gamma_inc(df / 2, x / 2), p, 0.0, 1e6)


def f_sf(x: float, d1: float, d2: float) -> float:
    if math.isnan(x):
        return math.nan
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def two_sided(stat: float, df: float = math.inf) -> float:
    """Two-sided p-value of a z (df infinite) or t statistic."""
    if math.isnan(stat):
        return math.nan
    if math.isinf(df):
        return math.erfc(abs(stat) / math.sqrt(2))
    return beta_inc(df / 2, 0.5, df / (df + stat * stat))
