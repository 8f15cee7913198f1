"""Linear and generalised linear models from one-pass sums."""

from __future__ import annotations

import math
import re
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.operators.core import DataInsufficient, Fit, cluster_factor, gram, inverse, lagged, lagged_meat, meat, moments, names_of, psd, solve_ls, usable


def parse(formula: str) -> tuple[str, list, list[str], bool]:
    """(outcome, terms, absorbed columns, intercept) of ``y ~ a + b:c + log(d) + I(e**2) + C(g) - 1 | f1 + f2``."""
    left, right = formula.split("~")
    right, _, absorbed = right.partition("|")
    intercept = not re.search(r"(^|[+\s])0(\s|$|\+)|-\s*1", right)
    terms: list = []
    for raw in re.split(r"\+(?![^(]*\))", re.sub(r"-\s*1", "", right)):
        t = raw.strip()
        if t in ("", "0", "1"):
            continue
        if "*" in t and "(" not in t:
            a, b = (x.strip() for x in t.split("*"))
            terms += [a, b, (f"{a}:{b}", F.col(a) * F.col(b))]
        elif ":" in t and "(" not in t:
            out = F.lit(1.0)
            for part in t.split(":"):
                out = out * F.col(part.strip())
            terms.append((t, out))
        elif m := re.fullmatch(r"(?:C|i)\((\w+)\)|i\.(\w+)", t):
            terms.append(("factor", m[1] or m[2]))
        elif m := re.fullmatch(r"I\((.*)\)", t):
            terms.append((t, F.expr(re.sub(r"(\w+)\s*\*\*\s*(\d+)", r"power(\1, \2)", m[1]))))
        elif "(" in t:
            terms.append((t, F.expr(t)))
        else:
            terms.append(t)
    return left.strip(), terms, [x.strip() for x in absorbed.split("+") if x.strip()], intercept


def outcome(name: str) -> tuple[str, Column]:
    return (name, F.expr(name)) if "(" in name else (name, F.col(name))


#: Levels of one factor that become dummies; beyond that, absorb the factor instead.
MOST_LEVELS = 200


def expand(df: DataFrame, terms: list) -> list:
    """Factors as dummies against their first level."""
    out = []
    for t in terms:
        if isinstance(t, tuple) and t[0] == "factor" and isinstance(t[1], str):
            levels = sorted((r[0] for r in df.select(t[1]).dropna().distinct().limit(MOST_LEVELS + 1).collect()), key=lambda v: (str(type(v)), v))
            if len(levels) > MOST_LEVELS:
                raise ValueError(f"{t[1]} has over {MOST_LEVELS} levels: absorb it (y ~ x | {t[1]})")
            out += [(f"{t[1]}[{v}]", (F.col(t[1]) == F.lit(v)).cast("double")) for v in levels[1:]]
        else:
            out.append(t)
    return out


def ols(df: DataFrame, y, x: list, *, vcov: str = "nonrobust", cluster: list[str] | str | None = None, weights: str | None = None, intercept: bool = True, order: str | None = None, lags: int = 4, factor: str = "stata") -> Fit:
    """Least squares.  vcov: nonrobust, HC0 to HC3, HAC (Newey-West along ``order``), cluster.

    ``cluster`` with several columns gives the multiway variance by inclusion and exclusion.
    Weights are scaled to sum to n; rows with a weight at or below 0 drop.
    """
    cl = [cluster] if isinstance(cluster, str) else list(cluster or [])
    yn, yc = y if isinstance(y, tuple) else (y, F.col(y))
    xs = names_of(expand(df, x))
    cols = {"__y": yc, **{f"__x{i}": c for i, c in enumerate(xs.values())}}
    if weights:
        cols["__w"] = F.col(weights)
    d = usable(df, cols, tuple(dict.fromkeys([*cl, *([order] if order else [])])))
    names = ["__y", *[f"__x{i}" for i in range(len(xs))]]
    if weights:
        d = d.where("__w > 0")
        total = d.agg(F.count("*"), F.sum("__w")).first()
        if not total[0]:
            raise DataInsufficient("no usable rows")
        d = d.withColumn("__w", F.col("__w") * (total[0] / total[1]))
    g = gram(d, names, "__w" if weights else None)
    k = len(xs) + intercept
    if g.rows <= k:
        raise DataInsufficient(f"{g.rows} rows for {k} coefficients")
    b, bread, rss = solve_ls(g, 0, list(range(1, len(names))), intercept)
    design = ([F.lit(1.0)] if intercept else []) + [F.col(c) for c in names[1:]]
    fitted = sum((F.lit(v) * c for v, c in zip(b.tolist(), design)), F.lit(0.0))
    w = F.col("__w") if weights else F.lit(1.0)
    e = w * (F.col("__y") - fitted)
    n, df_r = g.rows, float(g.rows - k)
    s2 = rss / df_r
    if cl:
        v, least = np.zeros((k, k)), None
        for bits in range(1, 1 << len(cl)):
            some = [c for i, c in enumerate(cl) if bits >> i & 1]
            m, groups = meat(d, [c * e for c in design], some)
            v += (-1) ** (len(some) + 1) * cluster_factor(factor, groups, n, k) * bread @ m @ bread
            least = groups if least is None or len(some) == 1 and groups < least else least
        v, df_r = (psd(v) if len(cl) > 1 else v), float(least - 1)
    elif vcov == "nonrobust":
        v = s2 * bread
    elif vcov == "HAC":
        v = bread @ lagged_meat(d, [c * e for c in design], order, lags) @ bread * n / (n - k)
    else:
        if vcov in ("HC2", "HC3"):
            h = F.lit(0.0)
            for i in range(k):
                for j in range(k):
                    h = h + F.lit(float(bread[i, j])) * design[i] * design[j]
            e = e / (F.sqrt(1 - w * h) if vcov == "HC2" else 1 - w * h)
        m, _ = meat(d, [c * e for c in design])
        v = bread @ m @ bread * (n / (n - k) if vcov == "HC1" else 1)
    tss = g.cross[0, 0] if intercept else g.cross[0, 0] + g.n * g.mean[0] ** 2
    names_out = (["Intercept"] if intercept else []) + list(xs)
    extra = {"r2": 1 - rss / tss if tss > 0 else math.nan, "rss": rss, "sigma": math.sqrt(max(s2, 0)), "bread": bread, "outcome": yn}
    return Fit(names_out, b, v, n, df_r, extra)


def regress(formula: str, df: DataFrame, **how) -> Fit:
    """``ols`` by formula, or ``glm`` with ``family=``; ``| f1 + f2`` absorbs fixed effects (least squares and Poisson)."""
    y, terms, absorbed, intercept = parse(formula)
    family = how.get("family")
    if absorbed and family not in (None, "poisson"):
        raise ValueError(f"effects are absorbed in least squares and Poisson models, not {family}")
    if absorbed and family:
        from abacist.operators.absorb import fepois

        return fepois(df, outcome(y), terms, absorbed, **{k: v for k, v in how.items() if k != "family"})
    if absorbed:
        from abacist.operators.panel import feols

        return feols(df, outcome(y), terms, absorbed, **how)
    return glm(df, outcome(y), terms, **how) if family else ols(df, outcome(y), terms, intercept=intercept, **how)


# ---------------------------------------------------------------- GLM
#: name -> (mean, its derivative, inverse of it for a start, variance, deviance of one row), as Column functions of eta, mu, y
FAMILIES = {
    "logit": ("binomial", lambda e: 1 / (1 + F.exp(-e)), lambda e, m: m * (1 - m), lambda m: F.log(m / (1 - m))),
    "probit": ("binomial", lambda e: _phi(e), lambda e, m: F.exp(-e * e / 2) / math.sqrt(2 * math.pi), None),
    "cloglog": ("binomial", lambda e: 1 - F.exp(-F.exp(e)), lambda e, m: F.exp(e - F.exp(e)), lambda m: F.log(-F.log(1 - m))),
    "poisson": ("poisson", lambda e: F.exp(e), lambda e, m: m, lambda m: F.log(m)),
    "gamma": ("gamma", lambda e: F.exp(e), lambda e, m: m, lambda m: F.log(m)),
    "gaussian": ("gaussian", lambda e: e, lambda e, m: F.lit(1.0), lambda m: m),
}


def _phi(e: Column) -> Column:
    """Normal distribution function as an expression: the complementary error function by Chebyshev fitting (1.2e-7)."""
    z = F.abs(e) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    # fixed values: coefficients of the published fit, highest power first
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    tail = 0.5 * t * F.exp(-z * z + poly)
    return F.when(e >= 0, 1 - tail).otherwise(tail)


def _variance(kind: str, m: Column) -> Column:
    return {"binomial": m * (1 - m), "poisson": m, "gamma": m * m, "gaussian": F.lit(1.0)}[kind]


def _deviance(kind: str, y: Column, m: Column) -> Column:
    xlogx = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0))
    return {
        "binomial": 2 * (xlogx(y, m) + xlogx(1 - y, 1 - m)),
        "poisson": 2 * (xlogx(y, m) - (y - m)),
        "gamma": 2 * (-F.log(y / m) + (y - m) / m),
        "gaussian": (y - m) * (y - m),
    }[kind]


def glm(df: DataFrame, y, x: list, *, family: str = "logit", vcov: str = "nonrobust", cluster: str | None = None, weights: str | None = None, tol: float = 1e-10, most: int = 50) -> Fit:
    """Iteratively reweighted least squares: each step is one weighted Gram of column expressions.

    The data are read once per step; cache ``df`` where it is costly to make.
    """
    kind, mean, slope, start = FAMILIES[family]
    yc = y[1] if isinstance(y, tuple) else F.col(y)
    xs = names_of(expand(df, x))
    cols = {"__y": yc, **{f"__x{i}": c for i, c in enumerate(xs.values())}}
    if weights:
        cols["__p"] = F.col(weights)
    d = usable(df, cols, (cluster,) if cluster else ())
    names = [f"__x{i}" for i in range(len(xs))]
    design = [F.lit(1.0), *[F.col(c) for c in names]]
    p = F.col("__p") if weights else F.lit(1.0)
    lo, hi = (1e-10, 1 - 1e-10) if kind == "binomial" else (1e-10, 1e15)
    bound = lambda m: m if kind == "gaussian" else F.least(F.greatest(m, F.lit(lo)), F.lit(hi))
    k, beta, last = len(design), None, None
    for step in range(most):
        if beta is None:
            average = d.agg(F.avg("__y")).first()[0]
            if average is None:
                raise DataInsufficient("no usable rows")
            mu = (F.col("__y") + 0.5) / 2 if kind == "binomial" else F.greatest((F.col("__y") + average) / 2, F.lit(1e-8)) if kind != "gaussian" else F.col("__y")
            eta = start(mu) if start else 1.7 * (mu - 0.5)
        else:
            eta = sum((F.lit(b) * c for b, c in zip(beta.tolist(), design)), F.lit(0.0))
            mu = bound(mean(eta))
        dm = slope(eta, mu)
        w = p * F.greatest(F.lit(1e-20), F.least(F.lit(1e20), dm * dm / _variance(kind, mu)))
        z = eta + (F.col("__y") - mu) / F.when(F.abs(dm) > 1e-12, dm).otherwise(F.lit(1e-12))
        f = d.select(*names, z.alias("__z"), w.alias("__wt"), (p * _deviance(kind, F.col("__y"), mu)).alias("__d"))
        sums = [F.sum(F.col("__wt") * a * b) for i, a in enumerate(design) for b in design[i:]] + [F.sum(F.col("__wt") * a * F.col("__z")) for a in design]
        row = f.agg(F.count("*"), F.sum("__d"), *sums).first()
        n, deviance = row[0], row[1]
        info, at = np.zeros((k, k)), 2
        for i in range(k):
            for j in range(i, k):
                info[i, j] = info[j, i] = row[at]
                at += 1
        if n <= k:
            raise DataInsufficient(f"{n} rows for {k} coefficients")
        if beta is not None and last is not None and abs(deviance - last) / (abs(last) + 0.1) < tol:
            break
        bread = inverse(info)
        beta, last = bread @ np.array(row[at:], dtype=float), deviance if beta is not None else None
    else:
        raise DataInsufficient(f"the model did not converge in {most} steps")
    bread = inverse(info)
    phi = 1.0
    if kind in ("gamma", "gaussian"):
        phi = d.agg(F.sum(p * (F.col("__y") - mu) ** 2 / _variance(kind, mu))).first()[0] / (n - k)
    v = phi * bread
    if vcov != "nonrobust" or cluster:
        score = p * (F.col("__y") - mu) * dm / _variance(kind, mu)
        m, groups = meat(d, [c * score for c in design], [cluster] if cluster else None)
        v = bread @ m @ bread * (groups / max(groups - 1, 1) if cluster else n / (n - k) if vcov == "HC1" else 1)
    return Fit(["Intercept", *xs], beta, v, n, math.inf, {"deviance": deviance, "phi": phi, "steps": step, "family": family})


def predicted(fit: Fit, cols: dict[str, Column]) -> Column:
    """Mean of a fitted GLM as an expression over the named columns."""
    return FAMILIES[fit.extra["family"]][1](fit.predict(cols))


def margins(fit: Fit, df: DataFrame, x: list) -> list[tuple[str, float, float]]:
    """(term, average marginal effect, delta-method standard error) of each continuous regressor."""
    xs = names_of(x)
    _, mean, slope, _ = FAMILIES[fit.extra["family"]]
    d = usable(df, {f"__x{i}": c for i, c in enumerate(xs.values())})
    design = [F.lit(1.0), *[F.col(f"__x{i}") for i in range(len(xs))]]
    eta = sum((F.lit(b) * c for b, c in zip(fit.beta.tolist(), design)), F.lit(0.0))
    mu = mean(eta)
    g = slope(eta, mu)
    # derivative of the slope, by family
    second = {"logit": g * (1 - 2 * mu), "probit": -eta * g, "cloglog": g * (1 - F.exp(eta)), "poisson": g, "gamma": g, "gaussian": F.lit(0.0)}[fit.extra["family"]]
    row = d.agg(F.avg(g), *[F.avg(second * c) for c in design]).first()
    out = []
    for j, name in enumerate(xs, 1):
        jac = fit.beta[j] * np.array(row[1:], dtype=float)
        jac[j] += row[0]
        out.append((name, float(fit.beta[j] * row[0]), float(math.sqrt(jac @ fit.vcov @ jac))))
    return out


# ---------------------------------------------------------------- instruments
def iv(df: DataFrame, y: str, endog: list[str], instruments: list[str], exog: list[str] = [], *, method: str = "2sls", vcov: str = "nonrobust", cluster: str | None = None, fuller: float = 1.0) -> Fit:
    """k-class estimators (2sls, liml, fuller) from one joint Gram of outcome, regressors and instruments."""
    cols = {"y": F.col(y), **{f"d{i}": F.col(c) for i, c in enumerate(endog)}, **{f"x{i}": F.col(c) for i, c in enumerate(exog)}, **{f"z{i}": F.col(c) for i, c in enumerate(instruments)}}
    if len(instruments) < len(endog):
        raise DataInsufficient("fewer instruments than endogenous regressors")
    d = usable(df, cols, (cluster,) if cluster else ())
    names = list(cols)
    g = gram(d, names)
    # all columns around their means: an instrument that varies little about a large mean is not collinear with the constant
    mean, spread = g.mean, np.diag(g.cross)
    if (spread[1:] <= 1e-26 * g.n * mean[1:] ** 2).any():
        raise DataInsufficient("a column is constant or empty")
    d = d.withColumns({c: F.col(c) - F.lit(m) for c, m in zip(names, mean.tolist())})
    g = replace(g, mean=np.zeros(len(names)))
    at = {c: i + 1 for i, c in enumerate(names)}
    m = moments(g, list(range(len(names))))
    Y, X, Z = [at["y"]], [0, *[at[c] for c in names if c[0] in "dx"]], [0, *[at[c] for c in names if c[0] in "xz"]]
    E = [0, *[at[c] for c in names if c[0] == "x"]]
    block = lambda a, b: m[np.ix_(a, b)]
    zz = inverse(block(Z, Z))
    project = lambda a, b: block(a, Z) @ zz @ block(Z, b)
    kappa = 1.0
    if method in ("liml", "fuller"):
        W = [at["y"], *[at[c] for c in names if c[0] == "d"]]
        ee = inverse(block(E, E))
        over = block(W, W) - block(W, E) @ ee @ block(E, W)
        under = block(W, W) - project(W, W)
        kappa = float(np.min(np.real(np.linalg.eigvals(np.linalg.solve(under, over)))))
        if method == "fuller":
            kappa -= fuller / (g.rows - len(Z))
    a = (1 - kappa) * block(X, X) + kappa * project(X, X)
    bread = inverse(a)
    b = bread @ ((1 - kappa) * block(X, Y) + kappa * project(X, Y))[:, 0]
    n, k = g.rows, len(X)
    design = [F.lit(1.0), *[F.col(names[i - 1]) for i in X[1:]]]
    e = F.col("y") - sum((F.lit(v) * c for v, c in zip(b.tolist(), design)), F.lit(0.0))
    first = zz @ block(Z, X)
    zcols = [F.lit(1.0), *[F.col(names[i - 1]) for i in Z[1:]]]
    fitted = [sum((F.lit(float(first[i, j])) * zcols[i] for i in range(len(Z))), F.lit(0.0)) for j in range(k)]
    fitted = [kappa * f + (1 - kappa) * c for f, c in zip(fitted, design)]
    rss = d.agg(F.sum(e * e)).first()[0]
    if cluster or vcov != "nonrobust":
        mt, groups = meat(d, [f * e for f in fitted], [cluster] if cluster else None)
        v = bread @ mt @ bread * (cluster_factor("stata", groups, n, k) if cluster else n / (n - k) if vcov == "HC1" else 1)
    else:
        v = rss / (n - k) * bread
    f_first = []
    for j in [i for i, c in enumerate(names, 1) if c[0] == "d"]:
        tss = block([j], [j]) - block([j], E) @ inverse(block(E, E)) @ block(E, [j])
        res = block([j], [j]) - project([j], [j])
        q = len(instruments)
        f_first.append(float((tss - res)[0, 0] / q / (res[0, 0] / (n - len(Z)))))
    sargan = math.nan
    if len(instruments) > len(endog):
        ze = block(Z, Y)[:, 0] - block(Z, X) @ b
        sargan = float(ze @ zz @ ze / (rss / n))
    shift = np.eye(k)  # the constant at the origin instead of at the means
    shift[0, 1:] = -mean[[i - 1 for i in X[1:]]]
    b, v = shift @ b, shift @ v @ shift.T
    b[0] += mean[0]
    label = dict(zip([*[f"d{i}" for i in range(len(endog))], *[f"x{i}" for i in range(len(exog))]], [*endog, *exog]))
    extra = {"first_stage_f": f_first, "kappa": kappa, "sargan": sargan, "rss": rss}
    return Fit(["Intercept", *[label[names[i - 1]] for i in X[1:]]], b, v, n, float(n - k), extra)


def anderson_rubin(df: DataFrame, y: str, endog: str, instruments: list[str], beta0: float = 0.0) -> tuple[float, float]:
    """(F, p) of the hypothesis that the coefficient is ``beta0``, valid with weak instruments."""
    d = usable(df, {"u": F.col(y) - F.lit(beta0) * F.col(endog), **{f"z{i}": F.col(c) for i, c in enumerate(instruments)}})
    g = gram(d, ["u", *[f"z{i}" for i in range(len(instruments))]])
    _, _, rss = solve_ls(g, 0, list(range(1, 1 + len(instruments))))
    q, rest = len(instruments), g.rows - len(instruments) - 1
    f = (g.cross[0, 0] - rss) / q / (rss / rest)
    return f, dist.f_sf(f, q, rest)


# ---------------------------------------------------------------- tests after a fit
def wald(fit: Fit, restrictions: np.ndarray, value: np.ndarray | None = None) -> tuple[float, float]:
    """(statistic, p) of linear restrictions: F with finite degrees of freedom, chi-square otherwise."""
    r = np.atleast_2d(restrictions)
    d = r @ fit.beta - (0 if value is None else value)
    stat = float(d @ np.linalg.solve(r @ fit.vcov @ r.T, d))
    if math.isinf(fit.df):
        return stat, dist.chi2_sf(stat, len(r))
    return stat / len(r), dist.f_sf(stat / len(r), len(r), fit.df)


def lincom(fit: Fit, weights: dict[str, float]) -> tuple[float, float, float]:
    """(estimate, standard error, p) of a linear combination of coefficients."""
    a = np.array([weights.get(n, 0.0) for n in fit.names])
    est, se = float(a @ fit.beta), float(math.sqrt(a @ fit.vcov @ a))
    return est, se, dist.two_sided(est / se, fit.df)


def _residuals(df: DataFrame, y: str, x: list[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, Fit]:
    d = usable(df, names_of([y, *x]), keep)
    fit = ols(d, y, x)
    cols = {c: F.col(c) for c in x}
    return d.withColumn("__fit", fit.predict(cols)).withColumn("__e", F.col(y) - F.col("__fit")), fit


def breusch_pagan(df: DataFrame, y: str, x: list[str]) -> tuple[float, float]:
    """(LM, p) of a regression of squared residuals on the regressors (Koenker's form)."""
    d, fit = _residuals(df, y, x)
    aux = ols(d.withColumn("__e2", F.col("__e") * F.col("__e")), "__e2", x)
    lm = aux.n * aux.extra["r2"]
    return lm, dist.chi2_sf(lm, len(x))


def white_test(df: DataFrame, y: str, x: list[str]) -> tuple[float, float]:
    """(LM, p) with squares and cross-products."""
    d, _ = _residuals(df, y, x)
    more = [(f"{a}*{b}", F.col(a) * F.col(b)) for i, a in enumerate(x) for b in x[i:]]
    aux = ols(d.withColumn("__e2", F.col("__e") * F.col("__e")), "__e2", [*x, *more])
    lm = aux.n * aux.extra["r2"]
    return lm, dist.chi2_sf(lm, len(x) + len(more))


def reset_test(df: DataFrame, y: str, x: list[str], powers: int = 3) -> tuple[float, float]:
    """(F, p) of adding powers of the fitted values, standardised for stability."""
    d, fit = _residuals(df, y, x)
    m, s = d.agg(F.avg("__fit"), F.stddev("__fit")).first()
    z = (F.col("__fit") - m) / s
    full = ols(d, y, [*x, *[(f"fit^{p}", F.pow(z, F.lit(p))) for p in range(2, powers + 1)]])
    q, rest = powers - 1, full.n - len(full.names)
    f = (fit.extra["rss"] - full.extra["rss"]) / q / (full.extra["rss"] / rest)
    return f, dist.f_sf(f, q, rest)


def vif(df: DataFrame, x: list[str]) -> dict[str, float]:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    g = gram(usable(df, names_of(x)), x)
    s = np.sqrt(np.diag(g.cross))
    return dict(zip(x, np.diag(np.linalg.inv(g.cross / np.outer(s, s))).tolist()))


def durbin_watson(df: DataFrame, y: str, x: list[str], order: str, within: str | None = None) -> float:
    d, _ = _residuals(df, y, x, tuple(c for c in (order, within) if c))
    row = lagged(d, order, ["__e"], 1, [within] if within else []).withColumn("__d", F.col("__e") - F.col("__e_1")).agg(F.sum(F.col("__d") ** 2), F.sum(F.col("__e") ** 2)).first()
    return row[0] / row[1]


def jarque_bera(df: DataFrame, y: str) -> tuple[float, float]:
    n, s, k = usable(df, names_of([y])).agg(F.count("*"), F.skewness(y), F.kurtosis(y)).first()
    jb = n / 6 * (s * s + k * k / 4)
    return jb, dist.chi2_sf(jb, 2)


def hausman(a: Fit, b: Fit, names: list[str]) -> tuple[float, float]:
    """(chi-square, p): a consistent fit against an efficient one, over shared coefficients."""
    i, j = [a.names.index(n) for n in names], [b.names.index(n) for n in names]
    d = a.beta[i] - b.beta[j]
    h = float(d @ np.linalg.pinv(a.vcov[np.ix_(i, i)] - b.vcov[np.ix_(j, j)]) @ d)
    return h, dist.chi2_sf(h, len(names))
