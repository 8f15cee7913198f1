"""Limited outcomes and latent models: Newton or fixed-point steps over aggregated scores and informations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.operators.core import DataInsufficient, Fit, gram, inverse, meat, names_of, solve_ls, usable
from abacist.operators.regression import _phi, glm, ols


def _linear(b, cols):
    return sum((F.lit(float(v)) * c for v, c in zip(b, cols)), F.lit(0.0))


def _newton(d: DataFrame, k: int, pieces, start: np.ndarray, most: int = 60, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """(estimate, inverse information, log likelihood); ``pieces(b)`` gives (loglik, scores, upper hessian) columns."""
    b, last = start, None
    for _ in range(most):
        ll, score, hess = pieces(b)
        row = d.agg(F.sum(ll), *[F.sum(s) for s in score], *[F.sum(h) for h in hess]).first()
        u, h, at = np.array(row[1 : k + 1], dtype=float), np.zeros((k, k)), k + 1
        for i in range(k):
            for j in range(i, k):
                h[i, j] = h[j, i] = row[at]
                at += 1
        step = np.linalg.solve(-h, u)
        if last is not None and abs(row[0] - last) < tol * (abs(last) + 0.1):
            break
        last, b = row[0], b + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    else:
        raise DataInsufficient(f"Newton's method did not converge in {most} steps")
    return b, np.linalg.inv(-h), row[0]


def multinomial(df: DataFrame, y: str, x: list[str]) -> Fit:
    """Multinomial logit against the first outcome."""
    levels = sorted(r[0] for r in df.select(y).dropna().distinct().limit(51).collect())
    if len(levels) > 50:
        raise ValueError("over 50 outcomes")
    d = usable(df, names_of(x), (y,))
    X = [F.lit(1.0), *[F.col(c) for c in x]]
    p, m = len(X), len(levels) - 1
    Y = [(F.col(y) == F.lit(v)).cast("double") for v in levels[1:]]

    def pieces(b):
        eta = [_linear(b[i * p : (i + 1) * p], X) for i in range(m)]
        total = F.lit(1.0) + sum((F.exp(e) for e in eta), F.lit(0.0))
        P = [F.exp(e) / total for e in eta]
        ll = sum((a * e for a, e in zip(Y, eta)), F.lit(0.0)) - F.log(total)
        score = [(Y[i] - P[i]) * c for i in range(m) for c in X]
        at = [(i, c) for i in range(m) for c in X]
        hess = [-P[i] * ((1.0 if i == j else 0.0) - P[j]) * a * c for q, (i, a) in enumerate(at) for j, c in at[q:]]
        return ll, score, hess

    b, v, ll = _newton(d, p * m, pieces, np.zeros(p * m))
    return Fit([f"{level}:{n}" for level in levels[1:] for n in ["Intercept", *x]], b, v, d.count(), math.inf, {"loglik": ll})


def ordered_logit(df: DataFrame, y: str, x: list[str]) -> Fit:
    """Proportional odds: slopes, then cut points."""
    levels = sorted(r[0] for r in df.select(y).dropna().distinct().limit(51).collect())
    d = usable(df, names_of(x), (y,)).cache()
    X, K, k = [F.col(c) for c in x], len(levels) - 1, len(x)
    n = {r[0]: r[1] for r in d.groupBy(y).count().collect()}
    total, run, cuts = sum(n.values()), 0, []
    for v in levels[:-1]:
        run += n[v]
        cuts.append(math.log(run / (total - run)))
    rank = F.lit(K)
    for i, v in reversed(list(enumerate(levels))):
        rank = F.when(F.col(y) == F.lit(v), i).otherwise(rank)
    d = d.withColumn("__r", rank)

    def pieces(b):
        e = _linear(b[:k], X)
        up, lo = F.lit(None).cast("double"), F.lit(None).cast("double")
        for j in range(K):
            up = F.when(F.col("__r") == j, F.lit(float(b[k + j]))).otherwise(up)
            lo = F.when(F.col("__r") == j + 1, F.lit(float(b[k + j]))).otherwise(lo)
        s = lambda z: 1 / (1 + F.exp(-z))
        U, L = F.coalesce(s(up - e), F.lit(1.0)), F.coalesce(s(lo - e), F.lit(0.0))
        fu, fl, p = U * (1 - U), L * (1 - L), F.greatest(U - L, F.lit(1e-300))
        gu, gl = fu * (1 - 2 * U), fl * (1 - 2 * L)
        du = [(F.col("__r") == j).cast("double") for j in range(K)]
        dl = [(F.col("__r") == j + 1).cast("double") for j in range(K)]
        a = [*[-c for c in X], *du]  # derivative of the upper argument
        c_ = [*[-c for c in X], *dl]
        score = [(fu * a[i] - fl * c_[i]) / p for i in range(k + K)]
        hess = [(gu * a[i] * a[j] - gl * c_[i] * c_[j]) / p - score[i] * score[j] for i in range(k + K) for j in range(i, k + K)]
        return F.log(p), score, hess

    b, v, ll = _newton(d, k + K, pieces, np.array([0.0] * k + cuts))
    return Fit([*x, *[f"cut{i + 1}" for i in range(K)]], b, v, total, math.inf, {"loglik": ll})


def negative_binomial(df: DataFrame, y: str, x: list[str], most: int = 25) -> Fit:
    """NB2 counts: Poisson-type steps for the mean and moment steps for the dispersion."""
    d = usable(df, names_of([y, *x])).cache()
    fit = glm(d, y, x, family="poisson")
    X, alpha, b = [F.lit(1.0), *[F.col(c) for c in x]], 0.0, fit.beta
    k, n = len(X), fit.n
    for _ in range(most):
        mu = F.exp(_linear(b, X))
        w = mu / (1 + alpha * mu)
        row = d.agg(*[F.sum((F.col(y) - mu) / (1 + alpha * mu) * c) for c in X], *[F.sum(w * X[i] * X[j]) for i in range(k) for j in range(k)], F.sum((F.col(y) - mu) ** 2 / (mu + alpha * mu * mu)), F.sum(((F.col(y) - mu) ** 2 - F.col(y)) / (1 + alpha * mu) ** 2), F.sum(mu * mu / (1 + alpha * mu) ** 2)).first()
        info = np.array(row[k : k + k * k]).reshape(k, k)
        new = b + np.linalg.solve(info, np.array(row[:k], dtype=float))
        a = max(row[-2] / row[-1], 0.0)
        done = np.abs(new - b).max() < 1e-9 and abs(a - alpha) < 1e-9
        b, alpha = new, a
        if done:
            break
    else:
        raise DataInsufficient(f"the count model did not converge in {most} steps")
    return Fit(["Intercept", *x], b, inverse(info), n, math.inf, {"alpha": alpha})


def tobit(df: DataFrame, y: str, x: list[str], left: float = 0.0) -> Fit:
    """Left-censored normal regression in Olsen's parameters (concave), reported as coefficients and sigma."""
    d = usable(df, names_of([y, *x])).cache()
    start = ols(d, y, x)
    X, k = [F.lit(1.0), *[F.col(c) for c in x]], len(x) + 2
    cens = F.col(y) <= left

    def pieces(b):
        g, e = _linear(b[:-1], X), float(b[-1])
        z = F.lit(e) * (F.col(y) - left) - g  # standardised residual
        P = F.greatest(_phi(-g), F.lit(1e-300))
        mills = F.exp(-g * g / 2) / math.sqrt(2 * math.pi) / P
        ll = F.when(cens, F.log(P)).otherwise(math.log(e) - z * z / 2)
        sg = F.when(cens, -mills).otherwise(z)
        se = F.when(cens, F.lit(0.0)).otherwise(1 / e - z * (F.col(y) - left))
        hg = F.when(cens, -mills * (mills - g)).otherwise(F.lit(-1.0))
        hx = F.when(cens, F.lit(0.0)).otherwise(F.col(y) - left)
        he = F.when(cens, F.lit(0.0)).otherwise(-1 / (e * e) - (F.col(y) - left) ** 2)
        hess = []
        for i in range(k):
            for j in range(i, k):
                hess.append(he if i == k - 1 else hx * X[i] if j == k - 1 else hg * X[i] * X[j])
        return ll, [*[sg * c for c in X], se], hess

    s = start.extra["sigma"]
    shifted = start.beta.copy()
    shifted[0] -= left
    b, v, ll = _newton(d, k, pieces, np.append(shifted / s, 1 / s))
    sigma = 1 / b[-1]
    beta = b[:-1] * sigma
    jac = np.block([[np.eye(k - 1) * sigma, (-b[:-1] * sigma**2)[:, None]], [np.zeros((1, k - 1)), np.array([[-(sigma**2)]])]])
    beta[0] += left
    return Fit(["Intercept", *x, "sigma"], np.append(beta, sigma), jac @ v @ jac.T, start.n, math.inf, {"loglik": ll})


def heckman(df: DataFrame, y: str, x: list[str], selected: str, z: list[str]) -> Fit:
    """Two-step selection model: a probit of selection, then the outcome with the inverse Mills ratio (robust errors)."""
    first = glm(df, selected, z, family="probit")
    eta = first.predict({c: F.col(c).cast("double") for c in z})
    mills = F.exp(-eta * eta / 2) / math.sqrt(2 * math.pi) / F.greatest(_phi(eta), F.lit(1e-300))
    return ols(df.where(F.col(selected) == 1), y, [*x, ("mills", mills)], vcov="HC1")


def quantile_regression(df: DataFrame, y: str, x: list[str], q: float = 0.5, most: int = 200, tol: float = 1e-7) -> Fit:
    """Majorise-minimise steps, each a weighted Gram; sandwich variance with a kernel estimate of the density."""
    d = usable(df, names_of([y, *x])).cache()
    start = ols(d, y, x)
    X, b = [F.lit(1.0), *[F.col(c) for c in x]], start.beta.copy()
    k, n, eps = len(X), start.n, 1e-4 * start.extra["sigma"]
    for _ in range(most):
        e = F.col(y) - _linear(b, X)
        w = 1 / (eps + F.abs(e))
        row = d.agg(*[F.sum(w * X[i] * X[j]) for i in range(k) for j in range(k)], *[F.sum((w * F.col(y) + (2 * q - 1)) * c) for c in X]).first()
        new = np.linalg.solve(np.array(row[: k * k]).reshape(k, k), np.array(row[k * k :], dtype=float))
        done = np.abs(new - b).max() < tol * (1 + np.abs(b).max())
        b = new
        if done:
            break
    else:
        raise DataInsufficient(f"the quantile regression did not converge in {most} steps")
    e = F.col(y) - _linear(b, X)
    h = 1.06 * d.agg(F.stddev(e)).first()[0] * n**-0.2
    ke = F.exp(-(e / h) ** 2 / 2) / (h * math.sqrt(2 * math.pi))
    row = d.agg(*[F.sum(ke * X[i] * X[j]) for i in range(k) for j in range(k)], *[F.sum(X[i] * X[j]) for i in range(k) for j in range(k)]).first()
    j = inverse(np.array(row[: k * k]).reshape(k, k))
    return Fit(["Intercept", *x], b, q * (1 - q) * j @ np.array(row[k * k :]).reshape(k, k) @ j, n)


def random_intercept(df: DataFrame, y: str, x: list[str], group: str, most: int = 200) -> Fit:
    """Linear mixed model with a random intercept, by maximum likelihood over group sums.

    The groups' counts, means and cross-products are one table; the profile likelihood in the
    variance ratio needs sums over it by group size only.
    """
    names = [y, *x]
    d = usable(df, names_of(names), (group,))
    g = gram(d, names)
    means = d.groupBy(group).agg(F.count("*").cast("double").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)])
    shift = g.mean
    M = [F.col(f"m{i}") - F.lit(float(s)) for i, s in enumerate(shift)]
    k = len(names)
    sizes = means.groupBy("n").agg(F.count("*").alias("g"), *[F.sum(m) for m in M], *[F.sum(M[i] * M[j]) for i in range(k) for j in range(k)]).collect()
    if len(sizes) > 100_000:
        raise ValueError("too many distinct group sizes")
    S = np.array([[r[0], r[1], *r[2:]] for r in sizes], dtype=float)

    def parts(lam: float):
        # V^-1 = I - a J with a = lam / (1 + n lam)
        n, cnt = S[:, 0], S[:, 1]
        a = lam / (1 + n * lam)
        full = np.zeros((k + 1, k + 1))
        full[1:, 1:] = g.cross
        full[0, 0] = g.n
        c = a * n * n
        full[0, 0] -= (c * cnt).sum()
        full[0, 1:] -= (c[:, None] * S[:, 2 : 2 + k]).sum(0)
        full[1:, 0] = full[0, 1:]
        full[1:, 1:] -= (c[:, None] * S[:, 2 + k :]).sum(0).reshape(k, k)
        ix = [0, *range(2, k + 1)]
        bread = inverse(full[np.ix_(ix, ix)])
        b = bread @ full[ix, 1]
        rss = full[1, 1] - b @ full[ix, 1]
        s2 = rss / g.n
        ll = -0.5 * (g.n * (math.log(2 * math.pi * s2) + 1) + (cnt * np.log1p(n * lam)).sum())
        return ll, b, bread, s2

    lo, hi, r = -20.0, 10.0, (math.sqrt(5) - 1) / 2
    for _ in range(most):
        a, b_ = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b_) if parts(math.exp(a))[0] > parts(math.exp(b_))[0] else (a, hi)
        if hi - lo < 1e-10:
            break
    lam = math.exp((lo + hi) / 2)
    ll, b, bread, s2 = parts(lam)
    shift_m = np.eye(len(b))
    shift_m[0, 1:] = -shift[1:]
    beta = shift_m @ b
    beta[0] += shift[0]
    return Fit(["Intercept", *x], beta, s2 * shift_m @ bread @ shift_m.T, g.rows, math.inf, {"sigma_e": math.sqrt(s2), "sigma_u": math.sqrt(s2 * lam), "loglik": ll, "icc": lam / (1 + lam)})


def anderson_hsiao(df: DataFrame, y: str, unit: str, time: str, x: list[str] = []) -> Fit:
    """Dynamic panel: differenced equation with the second lag of the level as instrument for the lagged difference."""
    from abacist.operators.regression import iv

    w = Window.partitionBy(unit).orderBy(time)
    d = usable(df, names_of([y, *x]), (unit, time))
    d = d.withColumns({"__l1": F.lag(y).over(w), "__l2": F.lag(y, 2).over(w), **{f"__d{c}": F.col(c) - F.lag(c).over(w) for c in x}})
    d = d.select(unit, (F.col(y) - F.col("__l1")).alias("dy"), (F.col("__l1") - F.col("__l2")).alias("lag_dy"), F.col("__l2").alias("lag2"), *[F.col(f"__d{c}").alias(c) for c in x])
    return iv(d, "dy", ["lag_dy"], ["lag2"], x, cluster=unit)


def arellano_bond(df: DataFrame, y: str, unit: str, time: str, lags: int = 3) -> Fit:
    """One-step difference GMM with the second and further lags of the level as instruments (zero where missing).

    Each unit's moment sums are column expressions over its ordered rows; only k x k sums reach the driver.
    """
    w = Window.partitionBy(unit).orderBy(time)
    d = usable(df, {y: F.col(y)}, (unit, time))
    d = d.withColumns({f"__l{k}": F.lag(y, k).over(w) for k in range(1, lags + 3)})
    d = d.select(unit, time, (F.col(y) - F.col("__l1")).alias("dy"), (F.col("__l1") - F.col("__l2")).alias("dx"), *[F.coalesce(F.col(f"__l{k}"), F.lit(0.0)).alias(f"z{k - 2}") for k in range(2, lags + 2)]).dropna(subset=["dy", "dx"])
    Z = [f"z{i}" for i in range(lags)]
    d = d.withColumns({f"p_{z}": F.coalesce(F.lag(z).over(w), F.lit(0.0)) for z in Z})
    # H has 2 on the diagonal and -1 beside it
    h = [F.sum(2 * F.col(a) * F.col(b) - F.col(a) * F.col(f"p_{b}") - F.col(f"p_{a}") * F.col(b)) for a in Z for b in Z]
    row = d.agg(F.count("*"), *[F.sum(F.col(z) * F.col("dx")) for z in Z], *[F.sum(F.col(z) * F.col("dy")) for z in Z], *h).first()
    n, zx, zy = row[0], np.array(row[1 : 1 + lags], dtype=float), np.array(row[1 + lags : 1 + 2 * lags], dtype=float)
    W = np.linalg.pinv(np.array(row[1 + 2 * lags :], dtype=float).reshape(lags, lags))
    rho = float(zx @ W @ zy / (zx @ W @ zx))
    m, _ = meat(d, [F.col(z) * (F.col("dy") - rho * F.col("dx")) for z in Z], [unit])
    a = W @ zx / (zx @ W @ zx)
    return Fit(["lag"], np.array([rho]), np.array([[a @ m @ a]]), n)
