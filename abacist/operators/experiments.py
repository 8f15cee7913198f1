"""Experiments, uplift, robustness and shift-share designs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import clip, num, uniform
from abacist.operators.causal import fold_of
from abacist.operators.core import DataInsufficient, Fit, gram, names_of, quantiles, running, solve_ls, usable
from abacist.operators.regression import glm, iv, ols, predicted


def assign(df: DataFrame, keys: list[str], shares: dict[str, float], strata: list[str] = [], seed: int = 0) -> DataFrame:
    """Adds ``arm``: exact shares within strata by the order of a hash; without strata by the hash alone (no global sort)."""
    u = uniform(seed, F.lit("assign"), *[F.col(k) for k in keys])
    total, run = sum(shares.values()), 0.0
    if strata:
        w = Window.partitionBy(*strata)
        u = (F.row_number().over(w.orderBy(u, *keys)) - 0.5) / F.count("*").over(w)
    arm = F.lit(list(shares)[-1])
    cuts = []
    for name, s in shares.items():
        run += s / total
        cuts.append((run, name))
    for cut, name in reversed(cuts[:-1]):
        arm = F.when(u < cut, F.lit(name)).otherwise(arm)
    return df.withColumn("arm", arm)


def sample_ratio(df: DataFrame, arm: str, shares: dict) -> tuple[float, float]:
    """(chi-square, p) of the arm sizes against the intended shares."""
    n = {r[0]: r[1] for r in df.groupBy(arm).count().collect()}
    total, all_ = sum(shares.values()), sum(n.values())
    stat = sum((n.get(a, 0) - all_ * s / total) ** 2 / (all_ * s / total) for a, s in shares.items())
    return stat, dist.chi2_sf(stat, len(shares) - 1)


def cuped(df: DataFrame, y: str, treat: str, before: str) -> dict[str, float]:
    """Difference of means adjusted by a pre-period covariate."""
    d = usable(df, {"y": F.col(y), "t": F.col(treat), "x": F.col(before)})
    theta, m = d.agg(F.covar_pop("y", "x") / F.var_pop("x"), F.avg("x")).first()
    r = {x.t: x for x in d.withColumn("a", F.col("y") - theta * (F.col("x") - m)).groupBy("t").agg(F.avg("a").alias("m"), F.var_samp("a").alias("v"), F.count("*").alias("n")).collect()}
    est, se = r[1.0].m - r[0.0].m, math.sqrt(r[1.0].v / r[1.0].n + r[0.0].v / r[0.0].n)
    return {"estimate": est, "std_error": se, "theta": theta, "p_value": dist.two_sided(est / se)}


def lin_adjusted(df: DataFrame, y: str, treat: str, x: list[str]) -> Fit:
    """Regression adjustment with treatment-by-centred-covariate interactions, robust errors."""
    d = usable(df, names_of([y, treat, *x]))
    m = d.agg(*[F.avg(c) for c in x]).first()
    z = [(f"{c}_c", F.col(c) - F.lit(v)) for c, v in zip(x, m)]
    return ols(d, y, [treat, *z, *[(f"{treat}:{c}", F.col(treat) * e) for c, e in z]], vcov="HC2")


def difference_in_means(df: DataFrame, y: str, arm: str, control) -> DataFrame:
    """Each arm against control, with Welch errors."""
    d = df.select(num(y).alias("y"), F.col(arm).alias("arm")).dropna().groupBy("arm").agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"), F.count("*").alias("n"))
    c = d.where(F.col("arm") == F.lit(control)).select(F.col("m").alias("m0"), F.col("v").alias("v0"), F.col("n").alias("n0"))
    return d.where(F.col("arm") != F.lit(control)).crossJoin(F.broadcast(c)).select("arm", (F.col("m") - F.col("m0")).alias("estimate"), F.sqrt(F.col("v") / F.col("n") + F.col("v0") / F.col("n0")).alias("std_error"), "n")  # one control row


def uplift_curve(df: DataFrame, y: str, treat: str, score: str, points: int = 10) -> DataFrame:
    """Cumulative gain by predicted uplift at equal shares of the rows (Qini), from distinct scores."""
    d = df.select(num(y).alias("y"), num(treat).alias("t"), num(score).alias("s")).dropna()
    per = d.groupBy("s").agg(F.count("*").alias("n"), F.sum("t").alias("n1"), F.sum(F.col("t") * F.col("y")).alias("y1"), F.sum((1 - F.col("t")) * F.col("y")).alias("y0"))
    c = running(per, "s", {v: F.col(v) for v in ("n", "n1", "y1", "y0")}, down=True)
    c = c.select((F.col("run_n") / F.col("all_n")).alias("share"), *[F.col(f"run_{v}").alias(v) for v in ("n", "n1", "y1", "y0")])
    gain = F.col("y1") - F.when(F.col("n") > F.col("n1"), F.col("y0") * F.col("n1") / (F.col("n") - F.col("n1"))).otherwise(0.0)
    return c.withColumn("gain", gain).groupBy(F.ceil(F.round(F.col("share") * points, 9)).alias("bin")).agg(F.max("share").alias("share"), F.max_by("gain", "share").alias("gain"))


def tmle(df: DataFrame, y: str, treat: str, x: list[str], trim: float = 0.01) -> dict[str, float]:
    """Targeted estimate of the average effect of a bounded outcome: logistic fluctuation of the initial fits."""
    d = usable(df, names_of([y, treat, *x]))
    lo, hi = d.agg(F.min(y), F.max(y)).first()
    d = d.withColumn("__y", (F.col(y) - lo) / (hi - lo)).cache()
    cols, t = {c: F.col(c) for c in x}, F.col(treat)
    e = clip(predicted(glm(d, treat, x), cols), trim, 1 - trim)
    m = {v: clip((ols(d.where(t == v), "__y", x).predict(cols)), 0.005, 0.995) for v in (1, 0)}
    q1, q0 = F.log(m[1] / (1 - m[1])), F.log(m[0] / (1 - m[0]))
    f = d.withColumns({"q1": q1, "q0": q0, "h1": 1 / e, "h0": -1 / (1 - e)})
    q, h = F.when(t == 1, F.col("q1")).otherwise(F.col("q0")), F.when(t == 1, F.col("h1")).otherwise(F.col("h0"))
    eps = 0.0
    for _ in range(30):
        p = 1 / (1 + F.exp(-(q + F.lit(eps) * h)))
        u, i = f.agg(F.sum(h * (F.col("__y") - p)), F.sum(h * h * p * (1 - p))).first()
        eps += u / i
        if abs(u / i) < 1e-10:
            break
    else:
        raise DataInsufficient("the targeting step did not converge")
    s = lambda a, b: 1 / (1 + F.exp(-(F.col(a) + F.lit(eps) * F.col(b))))
    p1, p0 = s("q1", "h1"), s("q0", "h0")
    ic = h * (F.col("__y") - F.when(t == 1, p1).otherwise(p0)) + p1 - p0
    est, var, n = f.agg(F.avg(p1 - p0), F.var_samp(ic), F.count("*")).first()
    se = math.sqrt(var / n) * (hi - lo)
    return {"estimate": est * (hi - lo), "std_error": se, "p_value": dist.two_sided(est * (hi - lo) / se)}


def marginal_structural(df: DataFrame, y: str, treat: str, unit: str, time: str, confounders: list[str]) -> Fit:
    """Stabilised weights over time (running products per unit), then the outcome on cumulative treatment."""
    d = usable(df, names_of([y, treat, *confounders]), (unit, time))
    w = Window.partitionBy(unit).orderBy(time)
    d = d.withColumn("__lag", F.coalesce(F.lag(treat).over(w), F.lit(0.0)))
    top, bottom = glm(d, treat, ["__lag"]), glm(d, treat, ["__lag", *confounders])
    p = lambda f, c: predicted(f, {v: F.col(v) for v in c})
    a, b = p(top, ["__lag"]), p(bottom, ["__lag", *confounders])
    t = F.col(treat)
    ratio = F.when(t == 1, a / b).otherwise((1 - a) / (1 - b))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"__w": F.exp(F.sum(F.log(ratio)).over(run)), "cumulative": F.sum(treat).over(run)})
    return ols(d, y, ["cumulative"], weights="__w", cluster=unit)


def bartik(df: DataFrame, shares: DataFrame, shocks: DataFrame, y: str, endog: str, region: str, industry: str, share: str, shock: str) -> Fit:
    """Shift-share instrument: shares joined with shocks, summed per region, then two-stage least squares."""
    z = shares.join(shocks, industry).groupBy(region).agg(F.sum(num(share) * num(shock)).alias("bartik"))
    return iv(df.join(z, region), y, [endog], ["bartik"], vcov="HC1")


def proximal(df: DataFrame, y: str, treat: str, z: str, w: str) -> Fit:
    """Proximal two-stage least squares: the outcome proxy is endogenous, the treatment proxy its instrument."""
    return iv(df, y, [w], [z], [treat], vcov="HC1")


def robustness_value(df: DataFrame, y: str, treat: str, x: list[str], q: float = 1.0) -> dict[str, float]:
    """Partial R2 of the treatment, and how strong confounding must be to take away a share q of the estimate."""
    fit = ols(df, y, [treat, *x])
    t = fit[treat] / fit.stderr(treat)
    f = q * abs(t) / math.sqrt(fit.df)
    return {"estimate": fit[treat], "t": t, "partial_r2": t * t / (t * t + fit.df), "robustness_value": 0.5 * (math.sqrt(f**4 + 4 * f**2) - f**2)}


def specification_curve(df: DataFrame, y: str, treat: str, controls: list[str], most: int = 256) -> DataFrame:
    """The treatment's coefficient under every subset of the controls, all from one Gram."""
    if 2 ** len(controls) > most:
        raise ValueError("too many subsets")
    names = [y, treat, *controls]
    g = gram(usable(df, names_of(names)), names)
    rows = []
    for bits in range(1 << len(controls)):
        on = [i for i in range(len(controls)) if bits >> i & 1]
        b, bread, rss = solve_ls(g, 0, [1, *[i + 2 for i in on]])
        rows.append(("+".join(controls[i] for i in on), float(b[1]), math.sqrt(rss / (g.rows - len(b)) * bread[1, 1])))
    return df.sparkSession.createDataFrame(rows, "controls string, estimate double, std_error double")


def placebo_outcomes(df: DataFrame, outcomes: list[str], treat: str) -> DataFrame:
    """Difference of means of several outcomes at once, Bonferroni-adjusted."""
    t = num(treat)
    aggs = [x for c in outcomes for x in (F.avg(F.when(t == 1, num(c))), F.avg(F.when(t == 0, num(c))), F.var_samp(F.when(t == 1, num(c))), F.var_samp(F.when(t == 0, num(c))), F.count(F.when(t == 1, num(c))), F.count(F.when(t == 0, num(c))))]
    r, rows = df.agg(*aggs).first(), []
    for i, c in enumerate(outcomes):
        m1, m0, v1, v0, n1, n0 = r[6 * i : 6 * i + 6]
        se = math.sqrt(v1 / n1 + v0 / n0)
        rows.append((c, m1 - m0, se, min(1.0, len(outcomes) * dist.two_sided((m1 - m0) / se))))
    return df.sparkSession.createDataFrame(rows, "outcome string, estimate double, std_error double, p_adjusted double")


def romano_wolf(df: DataFrame, outcomes: list[str], treat: str, keys: list[str], replicates: int = 200, seed: int = 0) -> DataFrame:
    """Step-down adjusted p-values from Poisson bootstrap replicates of all outcomes, taken in one pass per few replicates."""
    from abacist.functions.columns import poisson1

    t = num(treat)
    gap = lambda w, c: F.sum(w * t * num(c)) / F.sum(w * t) - F.sum(w * (1 - t) * num(c)) / F.sum(w * (1 - t))
    d = df.dropna(subset=[treat, *outcomes])
    est = np.array(d.agg(*[gap(F.lit(1.0), c) for c in outcomes]).first(), dtype=float)
    draws = []
    for a in range(0, replicates, 10):
        ws = [poisson1(seed, F.lit("romano"), F.lit(b), *[F.col(k) for k in keys]).cast("double") for b in range(a, min(a + 10, replicates))]
        r = d.agg(*[gap(w, c) for w in ws for c in outcomes]).first()
        draws.append(np.array(r, dtype=float).reshape(-1, len(outcomes)))
    D = np.concatenate(draws)
    se = D.std(axis=0, ddof=1)
    T, Z = np.abs(est / se), np.abs((D - est) / se)
    order, out, last = np.argsort(-T), {}, 0.0
    for i, j in enumerate(order):
        last = max(last, float((1 + (Z[:, order[i:]].max(axis=1) >= T[j]).sum()) / (1 + len(Z))))
        out[j] = last
    return df.sparkSession.createDataFrame([(c, float(est[j]), float(se[j]), out[j]) for j, c in enumerate(outcomes)], "outcome string, estimate double, std_error double, p_adjusted double")


def dose_response(df: DataFrame, y: str, dose: str, x: list[str], points: int = 10) -> DataFrame:
    """Generalised propensity score: normal dose model, outcome quadratic in dose and score, averaged at each dose."""
    d = usable(df, names_of([y, dose, *x])).cache()
    first = ols(d, dose, x)
    cols, s = {c: F.col(c) for c in x}, first.extra["sigma"]
    density = lambda at: F.exp(-((at - first.predict(cols)) / s) ** 2 / 2) / (s * math.sqrt(2 * math.pi))
    r = d.withColumn("r", density(F.col(dose)))
    t = F.col(dose)
    fit = ols(r, y, [("t", t), ("t2", t * t), ("r", F.col("r")), ("r2", F.col("r") ** 2), ("tr", t * F.col("r"))])
    grid = quantiles(d, [dose], [(i + 0.5) / points for i in range(points)]).first()[0]
    means = d.agg(*[F.avg(fit.predict({"t": F.lit(g), "t2": F.lit(g * g), "r": density(F.lit(g)), "r2": density(F.lit(g)) ** 2, "tr": F.lit(g) * density(F.lit(g))})) for g in grid]).first()
    d.unpersist()
    return df.sparkSession.createDataFrame([(float(g), float(m)) for g, m in zip(grid, means)], "dose double, outcome double")


def policy_tree(df: DataFrame, y: str, treat: str, x: list[str], bins: int = 32, trim: float = 0.01) -> dict:
    """Best single split by doubly robust scores, from histograms of every covariate in one aggregation each."""
    d = usable(df, names_of([y, treat, *x])).cache()
    cols, t = {c: F.col(c) for c in x}, F.col(treat)
    m1, m0 = (ols(d.where(t == v), y, x).predict(cols) for v in (1, 0))
    e = clip(predicted(glm(d, treat, x), cols), trim, 1 - trim)
    s = d.withColumn("__g", m1 - m0 + t * (F.col(y) - m1) / e - (1 - t) * (F.col(y) - m0) / (1 - e))
    total, n = s.agg(F.sum("__g"), F.count("*")).first()
    best = {"value": max(total, 0.0) / n, "feature": None, "cut": None, "treat_above": total > 0}
    for c, found in zip(x, quantiles(d, x, [i / bins for i in range(1, bins)]).first()):
        cuts = sorted(set(found))
        left = s.agg(*[F.sum(F.when(F.col(c) <= q, F.col("__g")).otherwise(0.0)) for q in cuts]).first()
        for q, v in zip(cuts, left):
            for above, value in ((True, total - v), (False, v)):
                if value / n > best["value"]:
                    best = {"value": value / n, "feature": c, "cut": q, "treat_above": above}
    d.unpersist()
    return best


def rosenbaum(df: DataFrame, gap: str, gamma: float) -> float:
    """Upper bound on the p-value of Wilcoxon's signed rank test of matched differences under hidden bias ``gamma``."""
    d = df.select(num(gap).alias("g")).where("g is not null and g <> 0").groupBy(F.abs("g").alias("a")).agg(F.count("*").alias("n"), F.count(F.when(F.col("g") > 0, 1)).alias("up"))
    d = running(d, "a", {"n": F.col("n")})
    r = d.withColumn("rank", F.col("run_n") - (F.col("n") - 1) / 2).agg(F.sum(F.col("up") * F.col("rank")), F.sum(F.col("n") * F.col("rank")), F.sum(F.col("n") * F.col("rank") ** 2)).first()
    p = gamma / (1 + gamma)
    return 1 - dist.norm_cdf((r[0] - p * r[1]) / math.sqrt(p * (1 - p) * r[2]))


def spatial_2sls(w: DataFrame, data: DataFrame, y: str, x: list[str]) -> Fit:
    """Spatial lag model: W y is instrumented by W x (Kelejian-Prucha), by joins on the neighbour table."""
    out = data.select("id", y, *x)
    for c in [y, *x]:
        lag = w.join(data.select(F.col("id").alias("j"), num(c).alias("__v")), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("w") * F.col("__v")).alias(f"w_{c}"))
        out = out.join(lag, "id")
    return iv(out, y, [f"w_{y}"], [f"w_{c}" for c in x], x, vcov="HC1")


def chow(df: DataFrame, y: str, x: list[str], group: str) -> tuple[float, float]:
    """(F, p) of equal coefficients in two groups."""
    from abacist.operators.core import grouped_gram

    names = [y, *x]
    d = usable(df, names_of(names), (group,))
    parts = grouped_gram(d, names, [group])
    if len(parts) != 2:
        raise DataInsufficient("two groups are needed")
    ix = list(range(1, len(names)))
    split = sum(solve_ls(g, 0, ix)[2] for g in parts.values())
    pooled, n, k = solve_ls(gram(d, names), 0, ix)[2], sum(g.rows for g in parts.values()), len(names)
    f = (pooled - split) / k / (split / (n - 2 * k))
    return f, dist.f_sf(f, k, n - 2 * k)


def dickey_fuller(df: DataFrame, y: str, time: str, lags: int = 1) -> float:
    """Augmented Dickey-Fuller t statistic with a constant."""
    w = Window.orderBy(time)
    s = df.groupBy(time).agg(F.avg(num(y)).alias("y")).withColumn("d", F.col("y") - F.lag("y").over(w))
    s = s.withColumns({"l": F.lag("y").over(w), **{f"d{k}": F.lag("d", k).over(w) for k in range(1, lags + 1)}})
    fit = ols(s, "d", ["l", *[f"d{k}" for k in range(1, lags + 1)]])
    return fit["l"] / fit.stderr("l")


def vector_autoregression(df: DataFrame, series: list[str], time: str, lags: int = 1) -> DataFrame:
    """Equation-by-equation least squares of each series on lags of all."""
    w = Window.orderBy(time)
    s = df.groupBy(time).agg(*[F.avg(num(c)).alias(c) for c in series])
    x = [f"L{k}_{c}" for k in range(1, lags + 1) for c in series]
    s = s.withColumns({f"L{k}_{c}": F.lag(c, k).over(w) for k in range(1, lags + 1) for c in series}).dropna()
    names = [*series, *x]
    g = gram(s, names)
    rows = []
    for i, c in enumerate(series):
        b, bread, rss = solve_ls(g, i, list(range(len(series), len(names))))
        v = rss / (g.rows - len(b)) * np.diag(bread)
        rows += [(c, n, float(q), float(math.sqrt(u))) for n, q, u in zip(["Intercept", *x], b, v)]
    return df.sparkSession.createDataFrame(rows, "equation string, term string, estimate double, std_error double")


def neyman(df: DataFrame, y: str, stratum: str, n: int) -> DataFrame:
    """(stratum, size, share, sample): rows to draw per stratum, in proportion to its size times its spread."""
    d = df.select(F.col(stratum).alias("stratum"), num(y).alias("y")).where("stratum is not null").groupBy("stratum").agg(F.count("*").alias("size"), F.coalesce(F.stddev("y"), F.lit(0.0)).alias("sd"))
    total = d.agg(F.sum(F.col("size") * F.col("sd"))).first()[0]
    share = F.col("size") * F.col("sd") / total
    return d.select("stratum", "size", share.alias("share"), F.round(share * n).cast("long").alias("sample"))


def prediction_powered_mean(df: DataFrame, y: str, prediction: str) -> dict[str, float]:
    """Mean of an outcome known for some rows, with a prediction for all: the prediction's mean plus its mean error where known."""
    d = df.select(num(y).alias("y"), num(prediction).alias("f")).where("f is not null")
    e = F.col("y") - F.col("f")
    f = F.when(F.col("y").isNull(), F.col("f"))
    mf, vf, nf, me, ve, ne = d.agg(F.avg(f), F.var_samp(f), F.count(f), F.avg(e), F.var_samp(e), F.count(e)).first()
    if not nf or not ne:
        raise DataInsufficient("rows with and without an outcome are needed")
    return {"mean": mf + me, "std_error": math.sqrt(vf / nf + ve / ne), "known": ne, "predicted": nf}


def pairwise_means(df: DataFrame, y: str, group: str) -> DataFrame:
    """Differences of all pairs of groups with Welch errors; groups are few."""
    m = df.select(F.col(group).alias("g"), num(y).alias("y")).dropna().groupBy("g").agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"), F.count("*").alias("n"))
    a, b = (m.select(*[F.col(c).alias(f"{c}_{s}") for c in m.columns]) for s in "ab")
    gap = F.sqrt(F.col("v_a") / F.col("n_a") + F.col("v_b") / F.col("n_b"))
    return a.join(b, F.col("g_a") < F.col("g_b")).select(F.col("g_a").alias("a"), F.col("g_b").alias("b"), (F.col("m_b") - F.col("m_a")).alias("difference"), gap.alias("std_error"))


def frontier(df: DataFrame, y: str, x: list[str], cost: bool = False) -> dict[str, float]:
    """Stochastic frontier with half-normal inefficiency by moments: least squares, then its residuals' second and third moments.

    Residuals skewed the wrong way give an inefficiency of zero.
    """
    from abacist.operators.regression import _residuals

    d, fit = _residuals(df, y, x)
    m2, m3, n = d.agg(F.avg(F.col("__e") ** 2), F.avg(F.col("__e") ** 3), F.count("*")).first()
    m3 = m3 if cost else -m3
    su = (max(m3, 0.0) / (math.sqrt(2 / math.pi) * (4 / math.pi - 1))) ** (1 / 3)
    sv2 = max(m2 - (1 - 2 / math.pi) * su * su, 0.0)
    shift = su * math.sqrt(2 / math.pi)
    return {"intercept": fit["Intercept"] + (-shift if cost else shift), **{c: fit[c] for c in x}, "sigma_u": su, "sigma_v": math.sqrt(sv2), "gamma": su * su / (su * su + sv2) if su + sv2 else 0.0}


def stepwise(df: DataFrame, y: str, x: list[str], criterion: str = "bic") -> list[tuple[str, float]]:
    """Forward selection by AIC or BIC on one Gram matrix: (column, criterion after it) in order of choice."""
    d = usable(df, names_of([y, *x]))
    g = gram(d, [y, *x])
    cost = math.log(g.n) if criterion == "bic" else 2.0
    score = lambda some: g.n * math.log(max(solve_ls(g, 0, some)[2], 1e-300) / g.n) + cost * (len(some) + 1)
    chosen, best, out = [], score([]), []
    while len(chosen) < len(x):
        at, i = min((score([*chosen, i]), i) for i in range(1, len(x) + 1) if i not in chosen)
        if at >= best:
            break
        chosen, best = [*chosen, i], at
        out.append((x[i - 1], at))
    return out
