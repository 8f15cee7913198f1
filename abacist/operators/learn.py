"""Penalised regression, conformal intervals and principal components on one-pass Grams."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.operators.causal import fold_of
from abacist.operators.core import Fit, gram, names_of, quantiles, usable
from abacist.operators.regression import ols


def coordinate_descent(c: np.ndarray, r: np.ndarray, penalty: np.ndarray, ridge: float = 0.0, tol: float = 1e-12, most: int = 10_000) -> np.ndarray:
    """Minimise b'cb/2 - r'b + sum(penalty |b|) + ridge |b|^2 / 2."""
    b = np.zeros(len(r))
    for _ in range(most):
        worst = 0.0
        for j in range(len(r)):
            rho = r[j] - c[j] @ b + c[j, j] * b[j]
            new = math.copysign(max(abs(rho) - penalty[j], 0.0), rho) / (c[j, j] + ridge)
            worst, b[j] = max(worst, abs(new - b[j])), new
        if worst < tol:
            break
    return b


def elastic_net(df: DataFrame, y: str, x: list[str], lam: float, mix: float = 1.0) -> dict[str, float]:
    """Coefficients on the original scale; the penalty applies to standardised columns."""
    names = [y, *x]
    g = gram(usable(df, names_of(names)), names)
    s = np.sqrt(np.diag(g.cross)[1:] / g.n)
    s[s == 0] = 1.0
    c, r = g.cross[1:, 1:] / g.n / np.outer(s, s), g.cross[1:, 0] / g.n / s
    b = coordinate_descent(c, r, np.full(len(x), lam * mix), lam * (1 - mix)) / s
    return {"Intercept": float(g.mean[0] - g.mean[1:] @ b), **dict(zip(x, b.tolist()))}


def ridge(df: DataFrame, y: str, x: list[str], lam: float) -> dict[str, float]:
    return elastic_net(df, y, x, lam, 0.0)


def rigorous_lasso(df: DataFrame, y: str, x: list[str], c: float = 1.1, gamma: float | None = None, rounds: int = 15) -> dict[str, float]:
    """Lasso with the data-driven penalty of Belloni et al.: loadings from residuals, one aggregation a round; post-lasso fit."""
    names = [y, *x]
    d = usable(df, names_of(names))
    g = gram(d, names)
    n, p = g.n, len(x)
    lam = 2 * c * math.sqrt(n) * dist.norm_ppf(1 - (gamma or 0.1 / math.log(n)) / (2 * p))
    b = np.zeros(p)
    m = dict(zip(names, g.mean.tolist()))
    z = [F.col(v) - m[v] for v in x]
    for _ in range(rounds):
        e = F.col(y) - m[y] - sum((F.lit(v) * q for v, q in zip(b.tolist(), z)), F.lit(0.0))
        load = np.sqrt(np.array(d.agg(*[F.avg(q * q * e * e) for q in z]).first(), dtype=float))
        new = coordinate_descent(g.cross[1:, 1:], g.cross[1:, 0], lam * load / 2)
        keep = np.flatnonzero(new)
        post = np.zeros(p)
        if len(keep):
            post[keep] = np.linalg.solve(g.cross[1:, 1:][np.ix_(keep, keep)], g.cross[1:, 0][keep])
        done, b = np.abs(post - b).max() < 1e-8, post
        if done:
            break
    return {"Intercept": float(g.mean[0] - g.mean[1:] @ b), **{v: float(q) for v, q in zip(x, b) if q}}


def double_selection(df: DataFrame, y: str, treat: str, x: list[str]) -> Fit:
    """Controls chosen by lasso for the outcome and for the treatment; then least squares with robust errors."""
    a, b = rigorous_lasso(df, y, x), rigorous_lasso(df, treat, x)
    return ols(df, y, [treat, *[v for v in x if v in a or v in b]], vcov="HC1")


def conformal(df: DataFrame, y: str, x: list[str], key: str, alpha: float = 0.1, seed: int = 0) -> tuple[Fit, float]:
    """Split conformal prediction: a fit on one half and the interval's half width from the other."""
    d = usable(df, names_of([y, *x]), (key,)).withColumn("__f", fold_of(2, seed, F.col(key)))
    fit = ols(d.where("__f = 0"), y, x)
    r = d.where("__f = 1").select(F.abs(F.col(y) - fit.predict({c: F.col(c) for c in x})).alias("r"))
    n = r.count()
    level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)
    return fit, quantiles(r, ["r"], [level]).first()[0][0]


def pca(df: DataFrame, x: list[str], k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(explained shares, loadings) of the correlation matrix."""
    g = gram(usable(df, names_of(x)), x)
    s = np.sqrt(np.diag(g.cross))
    w, u = np.linalg.eigh(g.cross / np.outer(s, s))
    return w[::-1][:k] / len(x), u[:, ::-1][:, :k]


def partial_correlations(df: DataFrame, x: list[str]) -> np.ndarray:
    g = gram(usable(df, names_of(x)), x)
    p = np.linalg.inv(g.cross)
    s = np.sqrt(np.diag(p))
    return -p / np.outer(s, s) + 2 * np.eye(len(x))


def pc_skeleton(df: DataFrame, x: list[str], alpha: float = 0.05) -> list[tuple[str, str]]:
    """Edges that no conditioning set removes (PC algorithm, Fisher z tests on the correlation matrix)."""
    from itertools import combinations

    g = gram(usable(df, names_of(x)), x)
    s = np.sqrt(np.diag(g.cross))
    c, p = g.cross / np.outer(s, s), len(x)
    near = {i: set(range(p)) - {i} for i in range(p)}
    for size in range(p - 1):
        for i in range(p):
            for j in sorted(near[i]):
                for some in combinations(sorted(near[i] - {j}), size):
                    q = np.linalg.inv(c[np.ix_([i, j, *some], [i, j, *some])])
                    r = -q[0, 1] / math.sqrt(q[0, 0] * q[1, 1])
                    z = math.sqrt(max(g.n - size - 3, 1)) * math.atanh(max(min(r, 1 - 1e-12), -1 + 1e-12))
                    if dist.two_sided(z) > alpha:
                        near[i].discard(j)
                        near[j].discard(i)
                        break
        if all(len(v) <= size for v in near.values()):
            break
    return [(x[i], x[j]) for i in range(p) for j in sorted(near[i]) if i < j]
