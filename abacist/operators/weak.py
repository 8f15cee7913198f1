"""Inference with weak instruments: rank statistics, the effective F, and the conditional likelihood ratio."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.operators.core import DataInsufficient, cluster_factor, gram, inverse, meat, usable


def _cleared(df: DataFrame, outcomes: list[str], instruments: list[str], exog: list[str], keep: tuple[str, ...] = ()):
    """(rows with outcomes ``u``, instruments ``z`` cleared of constant and controls, sums u'u, z'u, z'z of these, n)."""
    cols = {**{f"u{i}": F.col(c) for i, c in enumerate(outcomes)}, **{f"z{i}": F.col(c) for i, c in enumerate(instruments)}, **{f"w{i}": F.col(c) for i, c in enumerate(exog)}}
    d = usable(df, cols, keep)
    g = gram(d, list(cols))
    if g.rows <= len(instruments) + len(exog) + 1:
        raise DataInsufficient(f"{g.rows} rows for {len(instruments) + len(exog) + 1} coefficients")
    p, k = len(outcomes), len(instruments)
    main, ctrl = list(range(p + k)), list(range(p + k, len(cols)))
    slopes = inverse(g.cross[np.ix_(ctrl, ctrl)]) @ g.cross[np.ix_(ctrl, main)] if ctrl else np.zeros((0, p + k))
    c = g.cross[np.ix_(main, main)] - g.cross[np.ix_(main, ctrl)] @ slopes
    names = list(cols)
    clear = []
    for i in main:
        v = F.col(names[i]) - F.lit(float(g.mean[i]))
        for j, q in enumerate(ctrl):
            v = v - F.lit(float(slopes[j, i])) * (F.col(names[q]) - F.lit(float(g.mean[q])))
        clear.append(v.alias(names[i]))
    return d.select(*clear, *keep), c[:p, :p], c[p:, :p], c[p:, p:], g.rows


def _root(a: np.ndarray) -> np.ndarray:
    w, u = np.linalg.eigh(a)
    return (u * np.sqrt(np.maximum(w, 0))) @ u.T


def kleibergen_paap(df: DataFrame, endog: list[str], instruments: list[str], exog: list[str] = [], vcov: str = "robust", cluster: str | None = None) -> dict[str, float]:
    """Rank statistic of the first-stage coefficients: the hypothesis is that their rank is one less than full.

    ``wald`` is chi-squared with ``df`` = instruments - regressors + 1 degrees, ``f`` is it over the number of instruments;
    ``cragg_donald`` is the F of the least canonical correlation.  vcov: nonrobust, robust, or by ``cluster``.  One Gram,
    and one aggregation of the products of the scores z_i v_j.
    """
    p, k = len(endog), len(instruments)
    if k < p:
        raise DataInsufficient("fewer instruments than endogenous regressors")
    d, dd, zd, zz, n = _cleared(df, endog, instruments, exog, (cluster,) if cluster else ())
    zi = inverse(zz)
    pi, rest = zi @ zd, n - len(exog) - 1 - k
    sigma = (dd - zd.T @ pi) / rest
    if cluster or vcov == "robust":
        v = [F.col(f"u{j}") - sum((F.lit(float(pi[i, j])) * F.col(f"z{i}") for i in range(k)), F.lit(0.0)) for j in range(p)]
        s, groups = meat(d, [F.col(f"z{i}") * v[j] for i in range(k) for j in range(p)], [cluster] if cluster else None)
        bread = np.kron(zi, np.eye(p))
        cov = bread @ s @ bread * (cluster_factor("cgm", groups, n, k) if cluster else 1)
    elif vcov == "nonrobust":
        cov = np.kron(zi, sigma)
    else:
        raise ValueError(f"vcov is nonrobust, robust or cluster, not {vcov}")
    # coefficients scaled to unit instruments and residuals; the least singular value should be zero
    left, right = _root(zz), np.linalg.inv(_root(sigma))
    theta, turn = left @ pi @ right, np.kron(left, right)
    u, sv, vt = np.linalg.svd(theta)
    both = np.kron(u[:, p - 1 :].T, vt[p - 1 :])
    lam = both @ theta.reshape(-1)
    wald = float(lam @ np.linalg.solve(both @ turn @ cov @ turn.T @ both.T, lam))
    return {"wald": wald, "df": float(k - p + 1), "p_value": dist.chi2_sf(wald, k - p + 1), "f": wald / k, "cragg_donald": float(sv[p - 1] ** 2 / k), "n": float(n)}


def effective_f(df: DataFrame, endog: str, instruments: list[str], exog: list[str] = [], vcov: str = "HC1", cluster: str | None = None) -> dict[str, float]:
    """First-stage F that robust variances make comparable, and the plain one.  vcov: classic, HC0, HC1, or by ``cluster``."""
    d, dd, zd, zz, n = _cleared(df, [endog], instruments, exog, (cluster,) if cluster else ())
    k, zi = len(instruments), inverse(zz)
    pi = zi @ zd[:, 0]
    rest = n - len(exog) - 1 - k
    s2 = float(dd[0, 0] - zd[:, 0] @ pi) / rest
    if cluster or vcov in ("HC0", "HC1"):
        e = F.col("u0") - sum((F.lit(float(pi[i])) * F.col(f"z{i}") for i in range(k)), F.lit(0.0))
        s, groups = meat(d, [F.col(f"z{i}") * e for i in range(k)], [cluster] if cluster else None)
        s = s * (cluster_factor("cgm", groups, n, k) if cluster else n / rest if vcov == "HC1" else 1)
    elif vcov == "classic":
        s = s2 * zz
    else:
        raise ValueError(f"vcov is classic, HC0, HC1 or cluster, not {vcov}")
    q = float(pi @ zz @ pi)
    return {"effective_f": q / float(np.trace(s @ zi)), "first_stage_f": q / k / s2, "n": float(n)}


def _conditional_tail(stat: float, strength: float, k: int) -> float:
    """P(likelihood ratio > ``stat``) given the strength of ``k`` instruments, by quadrature over the angle between both parts."""
    if stat <= 0:
        return 1.0
    if k == 1:
        return dist.chi2_sf(stat, 1)
    at, weight = np.polynomial.legendre.leggauss(96)
    angle = (at + 1) * math.pi / 4
    scale = math.exp(math.lgamma(k / 2) - math.lgamma((k - 1) / 2)) / math.sqrt(math.pi)
    inner = [dist.chi2_sf((strength + stat) / (1 + strength * math.sin(a) ** 2 / stat), k) * math.cos(a) ** (k - 2) for a in angle.tolist()]
    return min(1.0, 2 * scale * math.pi / 4 * float(weight @ inner))


def conditional_lr(df: DataFrame, y: str, endog: str, instruments: list[str], exog: list[str] = [], beta0: float = 0.0) -> dict[str, float]:
    """Likelihood ratio test that the coefficient of ``endog`` is ``beta0``, conditional on the strength of the instruments.

    Right in size however weak these are; with one instrument it is the Anderson-Rubin test.  One Gram.
    """
    _, uu, zu, zz, n = _cleared(df, [y, endog], instruments, exog)
    k = len(instruments)
    turn = np.array([[1.0, 0.0], [-beta0, 1.0]])
    uu, zu = turn.T @ uu @ turn, zu @ turn
    zi = inverse(zz)
    s = (uu - zu.T @ zi @ zu) / (n - len(exog) - 1 - k)
    if s[0, 0] <= 0 or s[1, 1] - s[0, 1] ** 2 / s[0, 0] <= 0:
        raise DataInsufficient("outcome or regressor is explained without rest")
    a = zu[:, 0] / math.sqrt(s[0, 0])
    b = (zu[:, 1] - s[0, 1] / s[0, 0] * zu[:, 0]) / math.sqrt(s[1, 1] - s[0, 1] ** 2 / s[0, 0])
    ar, cross, strength = float(a @ zi @ a), float(a @ zi @ b), float(b @ zi @ b)
    stat = 0.5 * (ar - strength + math.sqrt(max((ar - strength) ** 2 + 4 * cross**2, 0.0)))
    lm = cross**2 / strength if strength > 0 else math.nan
    return {"statistic": stat, "p_value": _conditional_tail(stat, strength, k), "anderson_rubin": ar, "lm": lm, "strength": strength, "n": float(n)}
