"""Weighting, doubly robust estimation, matching, bounds, mediation and sensitivity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import clip, num, uniform
from abacist.operators.core import DataInsufficient, Fit, gram, grouped_gram, in_cells, inverse, merged, names_of, running, solve_ls, usable
from abacist.operators.regression import glm, ols, predicted


def propensity(df: DataFrame, treat: str, x: list[str], trim: float = 0.01, keep: tuple[str, ...] = ()) -> DataFrame:
    """Usable rows with ``ps``: the logit probability of treatment, clipped to [trim, 1 - trim]."""
    d = usable(df, names_of([treat, *x]), keep)
    fit = glm(d, treat, x, family="logit")
    return d.withColumn("ps", clip(predicted(fit, {c: F.col(c) for c in x}), trim, 1 - trim))


def ipw_weight(treat: Column, ps: Column, estimand: str = "ATE") -> Column:
    return {"ATE": treat / ps + (1 - treat) / (1 - ps), "ATT": treat + (1 - treat) * ps / (1 - ps), "ATC": treat * (1 - ps) / ps + (1 - treat), "ATO": treat * (1 - ps) + (1 - treat) * ps}[estimand]


def ipw(df: DataFrame, y: str, treat: str, x: list[str], estimand: str = "ATE", trim: float = 0.01) -> dict[str, float]:
    """Hajek-weighted difference of means; the standard error treats the scores as known (conservative for ATE)."""
    d = propensity(df, treat, x, trim, (y,)).withColumn("y", num(y)).where("y is not null")
    t, w = F.col(treat), ipw_weight(F.col(treat), F.col("ps"), estimand)
    d = d.withColumn("w", w)
    r = d.agg(F.sum(t * F.col("w") * F.col("y")) / F.sum(t * F.col("w")), F.sum((1 - t) * F.col("w") * F.col("y")) / F.sum((1 - t) * F.col("w")), F.sum(t * F.col("w")), F.sum((1 - t) * F.col("w")), F.count("*")).first()
    psi = t * F.col("w") * (F.col("y") - r[0]) / r[2] - (1 - t) * F.col("w") * (F.col("y") - r[1]) / r[3]
    return {"estimate": r[0] - r[1], "std_error": math.sqrt(d.agg(F.sum(psi * psi)).first()[0]), "n": float(r[4])}


def g_computation(df: DataFrame, y: str, treat: str, x: list[str]) -> dict[str, float]:
    """Outcome regressions per arm, averaged over all rows."""
    d = usable(df, names_of([y, treat, *x]))
    m = {v: ols(d.where(F.col(treat) == v), y, x) for v in (0, 1)}
    cols = {c: F.col(c) for c in x}
    e1, e0, n = d.agg(F.avg(m[1].predict(cols)), F.avg(m[0].predict(cols)), F.count("*")).first()
    return {"estimate": e1 - e0, "n": float(n)}


def fold_of(k: int, seed: int, *keys) -> Column:
    return F.floor(uniform(seed, F.lit("fold"), *keys) * k).cast("int")


def _by_fold(coefs: dict[int, np.ndarray], x: list[str]) -> Column:
    """Constant and slopes of the row's fold, applied to ``x``."""
    at = lambda j: F.element_at(F.array(*[F.lit(float(coefs[f][j])) for f in sorted(coefs)]), F.col("__f") + 1)
    return sum((at(j + 1) * F.col(c) for j, c in enumerate(x)), at(0))


def _fold_logit(d: DataFrame, treat: str, x: list[str], folds: int, tol: float = 1e-9, most: int = 50) -> dict[int, np.ndarray]:
    """Logit coefficients fitted on the rows outside each fold: every Newton step of all folds is one aggregation.

    Covariates are scaled to mean 0 and spread 1 while fitting; a fold leaves the sums once it has converged.
    """
    stats = d.agg(*[F.avg(c) for c in x], *[F.stddev(c) for c in x]).first()
    k, mid, sd = len(x) + 1, np.array(stats[: len(x)], dtype=float), np.array([s or 1.0 for s in stats[len(x) :]], dtype=float)
    z = [F.lit(1.0), *[(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(x, mid, sd)]]
    d = d.select("__f", F.col(treat).alias("__t"), *[v.alias(f"__z{i}") for i, v in enumerate(z)])
    z = [F.col(f"__z{i}") for i in range(k)]
    beta, open_ = {f: np.zeros(k) for f in range(folds)}, set(range(folds))
    for _ in range(most):
        live = sorted(open_)
        p = d.select("*", *[(1 / (1 + F.exp(-sum((F.lit(b) * v for b, v in zip(beta[f].tolist(), z)), F.lit(0.0))))).alias(f"__p{f}") for f in live])
        sums = []
        for f in live:
            rest = lambda v: F.sum(F.when(F.col("__f") != f, v))  # noqa: E731, B023  used at once
            m = F.col(f"__p{f}")
            sums += [rest((F.col("__t") - m) * v) for v in z] + [rest(m * (1 - m) * z[i] * z[j]) for i in range(k) for j in range(i, k)]
        row = iter(p.agg(*sums).first())
        for f in live:
            score, info = np.array([next(row) or 0.0 for _ in range(k)]), np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    info[i, j] = info[j, i] = next(row) or 0.0
            step = inverse(info) @ score
            beta[f] = beta[f] + step
            if np.abs(step).max() < tol:
                open_.discard(f)
        if not open_:
            break
    else:
        raise DataInsufficient("the treatment model does not converge: an arm may be separated")
    return {f: np.concatenate([[b[0] - (b[1:] * mid / sd).sum()], b[1:] / sd]) for f, b in beta.items()}


def aipw(df: DataFrame, y: str, treat: str, x: list[str], key: str, folds: int = 5, seed: int = 0, trim: float = 0.01) -> dict[str, float]:
    """Augmented inverse weighting with cross-fitted linear outcome and logit treatment models.

    One Gram by fold and arm gives all outcome models, the treatment models take one scan per Newton step.
    """
    d = usable(df, names_of([y, treat, *x]), (key,)).withColumn("__f", fold_of(folds, seed, F.col(key)))
    g = grouped_gram(d, [y, *x], ["__f", treat])
    rest = lambda f, v: merged([p for (h, t), p in g.items() if h != f and t == v])
    arm = {v: _by_fold({f: solve_ls(rest(f, v), 0, list(range(1, len(x) + 1)))[0] for f in range(folds)}, x) for v in (0, 1)}
    e = clip(1 / (1 + F.exp(-_by_fold(_fold_logit(d, treat, x, folds), x))), trim, 1 - trim)
    m = d.select(F.col(y).alias("v"), F.col(treat).alias("t"), arm[1].alias("m1"), arm[0].alias("m0"), e.alias("e"))
    psi = F.expr("m1 - m0 + t * (v - m1) / e - (1 - t) * (v - m0) / (1 - e)")
    est, var, n = m.select(psi.alias("p")).agg(F.avg("p"), F.var_samp("p"), F.count("*")).first()
    se = math.sqrt(var / n)
    return {"estimate": est, "std_error": se, "p_value": dist.two_sided(est / se), "n": float(n)}


def dml_plr(df: DataFrame, y: str, treat: str, x: list[str], key: str, folds: int = 5, seed: int = 0) -> dict[str, float]:
    """Partially linear model: residual on residual with cross-fitted linear nuisances, all from one Gram by fold."""
    d = usable(df, names_of([y, treat, *x]), (key,)).withColumn("__f", fold_of(folds, seed, F.col(key)))
    g = grouped_gram(d, [y, treat, *x], ["__f"])
    rest = {f: merged([p for (h,), p in g.items() if h != f]) for f in range(folds)}
    on = list(range(2, len(x) + 2))
    fitted = [_by_fold({f: solve_ls(rest[f], i, on)[0] for f in range(folds)}, x) for i in (0, 1)]
    r = d.select((F.col(y) - fitted[0]).alias("u"), (F.col(treat) - fitted[1]).alias("v"))
    uv, vv, n = r.agg(F.sum(F.col("u") * F.col("v")), F.sum(F.col("v") ** 2), F.count("*")).first()
    theta = uv / vv
    m = r.agg(F.sum(F.col("v") ** 2 * (F.col("u") - theta * F.col("v")) ** 2)).first()[0]
    se = math.sqrt(m) / vv
    return {"estimate": theta, "std_error": se, "p_value": dist.two_sided(theta / se), "n": float(n)}


def meta_learner(df: DataFrame, y: str, treat: str, x: list[str], kind: str = "t", trim: float = 0.01) -> DataFrame:
    """Usable rows with ``cate`` by S, T, X, R or DR learners on linear models."""
    d, cols, t = usable(df, names_of([y, treat, *x])), {c: F.col(c) for c in x}, F.col(treat)
    if kind == "s":
        inter = [(f"t:{c}", t * F.col(c)) for c in x]
        fit = ols(d, y, [treat, *x, *inter])
        return d.withColumn("cate", F.lit(fit[treat]) + sum((F.lit(fit[f"t:{c}"]) * F.col(c) for c in x), F.lit(0.0)))
    m1, m0 = (ols(d.where(t == v), y, x).predict(cols) for v in (1, 0))
    if kind == "t":
        return d.withColumn("cate", m1 - m0)
    e = clip(predicted(glm(d, treat, x, family="logit"), cols), trim, 1 - trim)
    if kind == "x":
        t1 = ols(d.where(t == 1), ("d", F.col(y) - m0), x).predict(cols)
        t0 = ols(d.where(t == 0), ("d", m1 - F.col(y)), x).predict(cols)
        return d.withColumn("cate", e * t0 + (1 - e) * t1)
    if kind == "dr":
        psi = m1 - m0 + t * (F.col(y) - m1) / e - (1 - t) * (F.col(y) - m0) / (1 - e)
        return d.withColumn("cate", ols(d, ("psi", psi), x).predict(cols))
    if kind == "r":
        m = ols(d, y, x).predict(cols)
        r = d.withColumns({"__v": t - e, "__u": F.col(y) - m})
        fit = ols(r, "__u", [("one", F.col("__v")), *[(c, F.col("__v") * F.col(c)) for c in x]], intercept=False)
        return d.withColumn("cate", F.lit(fit["one"]) + sum((F.lit(fit[c]) * F.col(c) for c in x), F.lit(0.0)))
    raise ValueError(kind)


def entropy_balance(df: DataFrame, treat: str, x: list[str], tol: float = 1e-10, most: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """Control weights whose covariate means equal the treated means: Newton steps on the dual, one aggregation each."""
    d = usable(df, names_of([treat, *x]), keep)
    stats = d.where(F.col(treat) == 1).agg(*[F.avg(c) for c in x], F.count("*")).first()
    goal, n1 = np.array(stats[:-1], dtype=float), stats[-1]
    scale = np.array([s or 1.0 for s in d.agg(*[F.stddev(c) for c in x]).first()])
    z = [(F.col(c) - F.lit(float(g))) / F.lit(float(s)) for c, g, s in zip(x, goal, scale)]
    c = d.where(F.col(treat) == 0).select(*[v.alias(f"z{i}") for i, v in enumerate(z)])
    k, lam = len(x), np.zeros(len(x))
    Z = [F.col(f"z{i}") for i in range(k)]
    for _ in range(most):
        w = F.exp(sum((F.lit(a) * v for a, v in zip(lam.tolist(), Z)), F.lit(0.0)))
        r = c.agg(F.sum(w), *[F.sum(w * v) for v in Z], *[F.sum(w * Z[i] * Z[j]) for i in range(k) for j in range(k)]).first()
        m = np.array(r[1 : k + 1]) / r[0]
        if np.abs(m).max() < tol:
            break
        h = np.array(r[k + 1 :]).reshape(k, k) / r[0] - np.outer(m, m)
        lam = lam - np.linalg.solve(h, m)
    else:
        raise DataInsufficient(f"balancing weights did not converge in {most} steps")
    full = F.exp(sum((F.lit(a) * v for a, v in zip(lam.tolist(), z)), F.lit(0.0))) * (n1 / r[0])
    return d.withColumn("weight", F.when(F.col(treat) == 1, 1.0).otherwise(full))


def match_nearest(df: DataFrame, treat: str, x: list[str], key: str, k: int = 1, caliper: float = 0.05, trim: float = 1e-6) -> DataFrame:
    """(key, match, distance, rank): up to k nearest controls by propensity within the caliper, with replacement.

    Scores are compared at a resolution of one millionth, so whatever the number of rows the ordered
    work runs on at most a million distinct scores, in cells of the caliper's width: a running count
    of controls gives each treated score its place, and the k places on either side are joined.
    """
    d = propensity(df, treat, x, trim, (key,)).select(F.col(key).alias("id"), F.col(treat).alias("t"), F.round("ps", 6).alias("ps"))
    cell = F.floor(F.col("ps") / caliper)
    controls = d.where("t = 0").withColumn("o", F.row_number().over(Window.partitionBy("ps").orderBy("id"))).where(F.col("o") <= k)
    spots = controls.select("ps").distinct().select("ps", F.lit(0).alias("t"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    line = spots.unionByName(d.where("t = 1").select("ps").distinct().select("ps", F.lit(1).alias("t"), cell.alias("cell")))
    place = F.sum(1 - F.col("t")).over(Window.partitionBy("cell").orderBy("ps", "t").rowsBetween(Window.unboundedPreceding, 0))
    line = line.withColumn("place", place)
    at = line.where("t = 0").select("cell", "place", F.col("ps").alias("cps"))
    want = line.where("t = 1").select("cell", "ps", F.explode(F.sequence(F.col("place") - (k - 1), F.col("place") + k)).alias("place"))
    near = want.join(at, ["cell", "place"]).withColumn("distance", F.abs(F.col("ps") - F.col("cps"))).where(F.col("distance") <= caliper)
    pairs = near.join(controls.select(F.col("ps").alias("cps"), F.col("id").alias("match")), "cps")
    best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("ps").orderBy("distance", "match"))).where(F.col("rank") <= k)
    return d.where("t = 1").select("id", "ps").join(best.select("ps", "match", "distance", "rank"), "ps").select(F.col("id").alias(key), "match", "distance", "rank")


def att_by_matching(df: DataFrame, y: str, treat: str, x: list[str], key: str, k: int = 1, caliper: float = 0.05) -> dict[str, float]:
    m = match_nearest(df, treat, x, key, k, caliper)
    ys = df.select(F.col(key), num(y).alias("y"))
    j = m.join(ys, key).join(ys.select(F.col(key).alias("match"), F.col("y").alias("y0")), "match")
    per = j.groupBy(key).agg(F.first("y").alias("y"), F.avg("y0").alias("y0"))
    est, sd, n = per.agg(F.avg(F.col("y") - F.col("y0")), F.stddev(F.col("y") - F.col("y0")), F.count("*")).first()
    return {"estimate": est, "std_error": sd / math.sqrt(n), "n": float(n)}


# ---------------------------------------------------------------- bounds
def manski(df: DataFrame, y: str, treat: str, low: float | None = None, high: float | None = None) -> dict[str, float]:
    """Worst-case bounds on the average effect of a bounded outcome."""
    d = df.select(num(y).alias("y"), num(treat).alias("t")).dropna()
    lo, hi, p, m1, m0 = d.agg(F.min("y"), F.max("y"), F.avg("t"), F.avg(F.when(F.col("t") == 1, F.col("y"))), F.avg(F.when(F.col("t") == 0, F.col("y")))).first()
    lo, hi = lo if low is None else low, hi if high is None else high
    return {"lower": m1 * p + lo * (1 - p) - m0 * (1 - p) - hi * p, "upper": m1 * p + hi * (1 - p) - m0 * (1 - p) - lo * p}


def lee(df: DataFrame, y: str, treat: str, selected: str) -> dict[str, float]:
    """Trimming bounds under selection: the arm with more retention keeps its lowest or highest outcomes.

    The kept sums come from running counts over distinct outcomes.
    """
    d = df.select(num(y).alias("y"), num(treat).alias("t"), num(selected).alias("s")).where("t is not null and s is not null")
    r = {x.t: x for x in d.groupBy("t").agg(F.avg("s").alias("p"), F.count(F.when((F.col("s") == 1) & F.col("y").isNotNull(), 1)).alias("n"), F.avg(F.when(F.col("s") == 1, F.col("y"))).alias("m")).collect()}
    more = 1.0 if r[1.0].p >= r[0.0].p else 0.0
    keep = math.floor(r[1 - more].p / r[more].p * r[more].n)
    v = d.where((F.col("t") == more) & (F.col("s") == 1)).where("y is not null").groupBy("y").agg(F.count("*").alias("n"))
    out = []
    v = in_cells(v, "y")
    for down in (False, True):
        before = F.col("run_n") - F.col("n")
        out.append(running(v, "y", {"n": F.col("n")}, down=down).withColumn("k", F.least("n", F.greatest(F.lit(keep) - before, F.lit(0)))).agg(F.sum(F.col("k") * F.col("y"))).first()[0] / keep)
    gaps = [m - r[0.0].m for m in out] if more == 1 else [r[1.0].m - m for m in out]
    return {"lower": min(gaps), "upper": max(gaps), "trimmed": 1 - keep / r[more].n}


def balke_pearl(df: DataFrame, y: str, treat: str, instrument: str) -> dict[str, float]:
    """Sharp bounds on the average effect with a binary instrument, treatment and outcome."""
    d = df.select(num(y).alias("y"), num(treat).alias("d"), num(instrument).alias("z")).dropna()
    c = {(r.y, r.d, r.z): r.n for r in d.groupBy("y", "d", "z").agg(F.count("*").alias("n")).collect()}
    n = {z: sum(v for k, v in c.items() if k[2] == z) for z in (0.0, 1.0)}
    p = lambda y_, d_, z: c.get((float(y_), float(d_), float(z)), 0) / n[float(z)]
    low = [
        p(1, 1, 1) + p(0, 0, 0) - 1, p(1, 1, 0) + p(0, 0, 1) - 1, p(1, 1, 0) - p(1, 1, 1) - p(1, 0, 1) - p(0, 1, 0) - p(1, 0, 0), p(1, 1, 1) - p(1, 1, 0) - p(1, 0, 0) - p(0, 1, 1) - p(1, 0, 1),
        -p(0, 1, 1) - p(1, 0, 1), -p(0, 1, 0) - p(1, 0, 0), p(0, 0, 1) - p(0, 1, 1) - p(1, 0, 1) - p(0, 1, 0) - p(0, 0, 0), p(0, 0, 0) - p(0, 1, 0) - p(1, 0, 0) - p(0, 1, 1) - p(0, 0, 1),
    ]
    high = [
        1 - p(0, 1, 1) - p(1, 0, 0), 1 - p(0, 1, 0) - p(1, 0, 1), -p(0, 1, 0) + p(0, 1, 1) + p(0, 0, 1) + p(1, 1, 0) + p(0, 0, 0), -p(0, 1, 1) + p(1, 1, 1) + p(0, 0, 1) + p(0, 1, 0) + p(0, 0, 0),
        p(1, 1, 1) + p(0, 0, 1), p(1, 1, 0) + p(0, 0, 0), -p(1, 0, 1) + p(1, 1, 1) + p(0, 0, 1) + p(1, 1, 0) + p(1, 0, 0), -p(1, 0, 0) + p(1, 1, 0) + p(0, 0, 0) + p(1, 1, 1) + p(1, 0, 1),
    ]
    return {"lower": max(low), "upper": min(high)}


def oster(df: DataFrame, y: str, treat: str, controls: list[str], r_max: float = 1.3) -> dict[str, float]:
    """Coefficient stability: bias-adjusted effect at delta 1, and the delta that takes it to zero (linear form)."""
    names = [y, treat, *controls]
    g = gram(usable(df, names_of(names)), names)
    tss = g.cross[0, 0]
    b0, _, rss0 = solve_ls(g, 0, [1])
    b1, _, rss1 = solve_ls(g, 0, list(range(1, len(names))))
    r0, r1 = 1 - rss0 / tss, 1 - rss1 / tss
    top = min(1.0, r_max * r1)
    bias = (b0[1] - b1[1]) * (top - r1) / (r1 - r0)
    return {"uncontrolled": float(b0[1]), "controlled": float(b1[1]), "r2_uncontrolled": r0, "r2_controlled": r1, "adjusted": float(b1[1] - bias), "delta": float(b1[1] / bias)}


# ---------------------------------------------------------------- mediation
def mediation(df: DataFrame, y: str, treat: str, mediator: str, x: list[str] = []) -> dict[str, float]:
    """Linear mediation: indirect a*b with Sobel's standard error, direct and total effects; one Gram."""
    names = [y, treat, mediator, *x]
    g = gram(usable(df, names_of(names)), names)
    rest = list(range(3, len(names)))
    a, bread_a, rss_a = solve_ls(g, 2, [1, *rest])
    b, bread_b, rss_b = solve_ls(g, 0, [1, 2, *rest])
    va = rss_a / (g.rows - 2 - len(x)) * bread_a[1, 1]
    vb = rss_b / (g.rows - 3 - len(x)) * bread_b[2, 2]
    se = math.sqrt(a[1] ** 2 * vb + b[2] ** 2 * va)
    return {"indirect": float(a[1] * b[2]), "std_error": se, "direct": float(b[1]), "total": float(a[1] * b[2] + b[1]), "p_value": dist.two_sided(float(a[1] * b[2]) / se)}


def front_door(df: DataFrame, y: str, treat: str, mediator: str) -> float:
    """Front-door effect of a binary treatment through a discrete mediator, from cell means."""
    d = df.select(num(y).alias("y"), num(treat).alias("t"), F.col(mediator).alias("m")).dropna()
    cell = d.groupBy("m", "t").agg(F.count("*").alias("n"), F.avg("y").alias("y"))
    arm = cell.groupBy("t").agg(F.sum("n").alias("nt"))
    c = cell.join(F.broadcast(arm), "t").withColumn("pm", F.col("n") / F.col("nt"))  # two arms
    total = d.count()
    per = c.groupBy("m").agg(F.sum(F.when(F.col("t") == 1, F.col("pm"))).alias("p1"), F.sum(F.when(F.col("t") == 0, F.col("pm"))).alias("p0"), F.sum(F.col("y") * F.col("nt") / total).alias("mean"))
    return per.agg(F.sum((F.coalesce("p1", F.lit(0.0)) - F.coalesce("p0", F.lit(0.0))) * F.col("mean"))).first()[0]


def wald_late(df: DataFrame, y: str, treat: str, instrument: str) -> dict[str, float]:
    """Effect on compliers: ratio of intention-to-treat effects, with the delta-method error."""
    d = usable(df, {"y": F.col(y), "d": F.col(treat), "z": F.col(instrument)})
    r = d.agg(F.covar_pop("y", "z") / F.covar_pop("d", "z"), F.covar_pop("d", "z") / F.var_pop("z"), F.count("*"), F.avg("y"), F.avg("d"), F.avg("z"), F.var_pop("z")).first()
    e = (F.col("y") - r[3]) - r[0] * (F.col("d") - r[4])
    m = d.agg(F.sum(((F.col("z") - r[5]) * e) ** 2)).first()[0]
    return {"late": r[0], "first_stage": r[1], "std_error": math.sqrt(m) / (r[2] * abs(r[1]) * r[6])}


# ---------------------------------------------------------------- policies and off-policy evaluation
def policy_value(df: DataFrame, reward: str, action: str, propensity_: str, policy: Column) -> dict[str, float]:
    """Inverse-propensity and self-normalised values of a policy from logged actions."""
    d = df.select(num(reward).alias("r"), F.when(F.col(action) == policy, 1 / num(propensity_)).otherwise(0.0).alias("w")).dropna()
    r = d.agg(F.avg(F.col("w") * F.col("r")), F.sum(F.col("w") * F.col("r")) / F.sum("w"), F.stddev(F.col("w") * F.col("r")), F.count("*"), F.sum("w") ** 2 / F.sum(F.col("w") ** 2)).first()
    return {"ips": r[0], "snips": r[1], "std_error": r[2] / math.sqrt(r[3]), "effective_n": r[4]}


def targeting(df: DataFrame, effect: str, fractions: list[float] = [0.1, 0.25, 0.5]) -> DataFrame:
    """Total effect of treating the highest fraction by predicted effect (positive only) against a random draw."""
    v = df.select(num(effect).alias("e")).dropna().groupBy("e").agg(F.count("*").alias("n"))
    n, mean = v.agg(F.sum("n"), F.sum(F.col("n") * F.col("e")) / F.sum("n")).first()
    v = running(v, "e", {"n": F.col("n")}, down=True).withColumn("before", F.col("run_n") - F.col("n")).where("e > 0")
    gain = [F.coalesce(F.sum(F.col("e") * F.least("n", F.greatest(F.lit(math.floor(f * n)) - F.col("before"), F.lit(0)))), F.lit(0.0)) for f in fractions]
    r = v.agg(*gain).first()
    return df.sparkSession.createDataFrame([(f, math.floor(f * n), g, math.floor(f * n) * mean) for f, g in zip(fractions, r)], "fraction double, budget long, gain double, random double")


def fairness(df: DataFrame, label: str, prediction: str, group: str) -> DataFrame:
    """Selection, true- and false-positive rates and accuracy per group; gaps follow from the rows."""
    d = df.select(num(label).alias("y"), num(prediction).alias("p"), F.col(group).alias("group")).where("y is not null and p is not null")
    y, p = F.col("y"), F.col("p")
    return d.groupBy("group").agg(F.count("*").alias("n"), F.avg("p").alias("selection_rate"), F.avg(F.when(y == 1, p)).alias("tpr"), F.avg(F.when(y == 0, p)).alias("fpr"), F.avg((y == p).cast("double")).alias("accuracy"))
