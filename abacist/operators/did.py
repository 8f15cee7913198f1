"""Difference in differences and staggered adoption."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import num
from abacist.operators.core import DataInsufficient, Fit, usable
from abacist.operators.panel import demean, feols, written
from abacist.operators.regression import ols


def _two(df: DataFrame, col: str):
    v = sorted(r[0] for r in df.select(col).dropna().distinct().limit(3).collect())
    if len(v) != 2:
        raise DataInsufficient(f"{col} must have two distinct values")
    return v


def did_2x2(df: DataFrame, y: str, treat: str, time: str, covariates: list[str] = [], **how) -> Fit:
    """Two groups, two periods: the coefficient of the interaction; the higher value of each codes 1."""
    a, b = _two(df, treat), _two(df, time)
    d = df.withColumns({"__d": (F.col(treat) == F.lit(a[1])).cast("double"), "__t": (F.col(time) == F.lit(b[1])).cast("double")})
    return ols(d, y, [("treated", F.col("__d")), ("post", F.col("__t")), ("did", F.col("__d") * F.col("__t")), *covariates], **how)


def ddd(df: DataFrame, y: str, treat: str, time: str, subgroup: str, **how) -> Fit:
    """Triple difference: the three-way interaction."""
    d, t, s = num(treat), num(time), num(subgroup)
    return ols(df, y, [("d", d), ("t", t), ("s", s), ("dt", d * t), ("ds", d * s), ("ts", t * s), ("ddd", d * t * s)], **how)


def twfe(df: DataFrame, y: str, d: str, unit: str, time: str, **how) -> Fit:
    return feols(df, y, [d], [unit, time], cluster=how.pop("cluster", unit), **how)


def event_study(df: DataFrame, y: str, first: str, unit: str, time: str, window: tuple[int, int] = (-4, 4), reference: int = -1) -> Fit:
    """Two-way fixed effects with a dummy per event time; the ends of the window are binned."""
    lo, hi = window
    e = F.when(F.col(first).isNotNull() & (F.col(first) > 0), F.least(F.greatest(F.col(time) - F.col(first), F.lit(lo)), F.lit(hi)))
    d = df.withColumn("__e", e)
    ks = sorted(int(r[0]) for r in d.select("__e").dropna().distinct().collect() if int(r[0]) != reference)  # within the window
    return feols(d, y, [(f"e{k}", F.coalesce((F.col("__e") == k).cast("double"), F.lit(0.0))) for k in ks], [unit, time], cluster=unit)


def _panel(df: DataFrame, y: str, first: str, unit: str, time: str) -> DataFrame:
    g = num(first)
    return df.select(F.col(unit).alias("i"), num(time).alias("t"), num(y).alias("y"), F.when(g > 0, g).otherwise(F.lit(None)).alias("g")).where("i is not null and t is not null and y is not null")


def att_gt(df: DataFrame, y: str, first: str, unit: str, time: str, control: str = "nevertreated", anticipation: int = 0) -> DataFrame:
    """(group, time, att, std_error, n_treated, n_control): difference of long differences per cohort and period.

    The base period is the one before the cohort's treatment (less anticipation).  One self-join of
    the panel on the unit gives the long differences; cohort-by-period sums are small.  Controls are
    units never treated or, with ``notyettreated``, also those treated later than the period.
    """
    p = _panel(df, y, first, unit, time)
    cohorts = sorted(r[0] for r in p.select("g").dropna().distinct().collect())
    times = sorted(r[0] for r in p.select("t").distinct().collect())
    before = lambda g: [t for t in times if t < g - anticipation]
    base = {g: before(g)[-1] for g in cohorts if before(g)}
    spark = df.sparkSession
    pairs = spark.createDataFrame([(g, t, b) for g, b in base.items() for t in times if t != b], "cohort double, t double, base double")
    late = F.col("g").isNull() if control == "nevertreated" else F.col("g").isNull() | (F.col("g") > F.greatest(F.col("t"), F.col("base")) + anticipation)
    post = p.join(F.broadcast(pairs), "t").where((F.col("g") == F.col("cohort")) | late)
    old = p.select("i", F.col("t").alias("base"), F.col("y").alias("y0"))
    long = post.join(old, ["i", "base"]).withColumn("dy", F.col("y") - F.col("y0"))
    d = F.coalesce(F.col("g") == F.col("cohort"), F.lit(False))
    m = lambda f, c: f(F.when(c, F.col("dy")))
    cells = long.groupBy("cohort", "t").agg(m(F.avg, d).alias("m1"), m(F.avg, ~d).alias("m0"), m(F.var_pop, d).alias("v1"), m(F.var_pop, ~d).alias("v0"), F.count(F.when(d, 1)).alias("n_treated"), F.count(F.when(~d, 1)).alias("n_control"))
    se = F.sqrt(F.col("v1") / F.col("n_treated") + F.col("v0") / F.col("n_control"))
    return cells.where("n_treated > 0 and n_control > 0").select(F.col("cohort").alias("group"), F.col("t").alias("time"), (F.col("m1") - F.col("m0")).alias("att"), se.alias("std_error"), "n_treated", "n_control")


def aggte(cells: DataFrame, kind: str = "simple") -> DataFrame:
    """Aggregate (group, time, att) cells: simple, dynamic, group or calendar, weighted by cohort size."""
    c = cells.withColumn("e", F.col("time") - F.col("group"))
    post = c.where("e >= 0")
    mean = (F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att")
    if kind == "simple":
        return post.agg(mean).select(F.lit("simple").alias("level"), "att")
    if kind == "dynamic":
        return c.groupBy("e").agg(mean).select(F.col("e").cast("string").alias("level"), "att")
    if kind == "group":
        return post.groupBy("group").agg(F.avg("att").alias("att")).select(F.col("group").cast("string").alias("level"), "att")
    if kind == "calendar":
        return post.groupBy("time").agg(mean).select(F.col("time").cast("string").alias("level"), "att")
    raise ValueError(kind)


def bacon(df: DataFrame, y: str, first: str, unit: str, time: str) -> DataFrame:
    """Goodman-Bacon decomposition of the two-way estimate of a balanced panel: (treated, control, kind, weight, estimate)."""
    p = _panel(df, y, first, unit, time)
    means = p.groupBy("g", "t").agg(F.avg("y").alias("m"), F.count("*").alias("n")).collect()
    times = sorted({r.t for r in means})
    size = {}
    for r in means:
        size[r.g] = r.n
    counts = p.groupBy("i").count().agg(F.min("count"), F.max("count")).first()
    if counts[0] != counts[1]:
        raise DataInsufficient("the panel is not balanced")
    mean = {(r.g, r.t): r.m for r in means}
    total = sum(size.values())
    share = {g: n / total for g, n in size.items()}
    treated = sorted(g for g in size if g is not None and g > times[0])
    out = []
    avg = lambda g, ts: sum(mean[g, t] for t in ts) / len(ts)
    for k in treated:
        dk = sum(t >= k for t in times) / len(times)
        others = [None] * (None in size) + [g for g in size if g is not None and g <= times[0]]
        for u in others:
            pre, post = [t for t in times if t < k], [t for t in times if t >= k]
            n = share[k] / (share[k] + share[u])
            s = (share[k] + share[u]) ** 2 * n * (1 - n) * dk * (1 - dk)
            out.append((k, u, "treated vs never" if u is None else "treated vs always", s, avg(k, post) - avg(k, pre) - avg(u, post) + avg(u, pre)))
        for l in (g for g in treated if g > k):
            dl = sum(t >= l for t in times) / len(times)
            n = share[k] / (share[k] + share[l])
            pre, mid, post = [t for t in times if t < k], [t for t in times if k <= t < l], [t for t in times if t >= l]
            both = (share[k] + share[l]) ** 2 * n * (1 - n)
            out.append((k, l, "earlier vs later", both * (dk - dl) * (1 - dk), avg(k, mid) - avg(k, pre) - avg(l, mid) + avg(l, pre)))
            out.append((l, k, "later vs earlier", both * dl * (dk - dl), avg(l, post) - avg(l, mid) - avg(k, post) + avg(k, mid)))
    w = sum(r[3] for r in out)
    return df.sparkSession.createDataFrame([(*r[:3], r[3] / w, r[4]) for r in out], "treated double, control double, kind string, weight double, estimate double")


def stacked(df: DataFrame, y: str, first: str, unit: str, time: str, window: tuple[int, int] = (-3, 3)) -> Fit:
    """Stacked event study: one clean two-group panel per cohort, effects per cohort; ``att`` is the mean post coefficient."""
    p = _panel(df, y, first, unit, time)
    lo, hi = window
    cohorts = p.select("g").dropna().distinct().withColumnRenamed("g", "c")
    s = p.join(F.broadcast(cohorts), (F.col("t") >= F.col("c") + lo) & (F.col("t") <= F.col("c") + hi)).where((F.col("g") == F.col("c")) | F.col("g").isNull() | (F.col("g") > F.col("c") + hi))
    d = F.coalesce(F.col("g") == F.col("c"), F.lit(False))
    s = s.withColumns({"ic": F.xxhash64("i", "c"), "tc": F.xxhash64("t", "c")})
    ks = [k for k in range(lo, hi + 1) if k != -1]
    fit = feols(s, "y", [(f"e{k}", (d & (F.col("t") - F.col("c") == k)).cast("double")) for k in ks], ["ic", "tc"], cluster="i")
    a = np.array([1.0 * (int(n[1:]) >= 0) for n in fit.names])
    a /= a.sum()
    fit.extra |= {"att": float(a @ fit.beta), "att_se": float(math.sqrt(a @ fit.vcov @ a))}
    return fit


def sun_abraham(df: DataFrame, y: str, first: str, unit: str, time: str, window: tuple[int, int] = (-4, 4)) -> DataFrame:
    """Interaction-weighted event study: cohort-by-event-time effects averaged by cohort shares."""
    p = _panel(df, y, first, unit, time)
    lo, hi = window
    e = F.least(F.greatest(F.col("t") - F.col("g"), F.lit(lo)), F.lit(hi))
    cells = [(r.g, int(r.e), r.n) for r in p.where("g is not null").groupBy("g", e.alias("e")).agg(F.count("*").alias("n")).collect() if int(r.e) != -1]
    fit = feols(p, "y", [(f"{g}|{k}", F.coalesce(((F.col("g") == g) & (e == k)), F.lit(False)).cast("double")) for g, k, _ in cells], ["i", "t"], cluster="i")
    rows = []
    for k in sorted({c[1] for c in cells}):
        a = np.array([float(n) if int(name.split("|")[1]) == k else 0.0 for name, (_, _, n) in zip(fit.names, cells)])
        a /= a.sum()
        est, se = float(a @ fit.beta), float(math.sqrt(max(a @ fit.vcov @ a, 0.0)))
        rows.append((k, est, se, dist.two_sided(est / se if se else math.nan)))
    return df.sparkSession.createDataFrame(rows, "e int, att double, std_error double, p_value double")


def imputation(df: DataFrame, y: str, first: str, unit: str, time: str) -> DataFrame:
    """Unit and time effects from untreated rows, solved on their level tables, then the mean gap of treated rows by event time (and overall, e null)."""
    from abacist.operators.absorb import absorbed

    p = _panel(df, y, first, unit, time)
    free = written(p.where("g is null or t < g").select("i", "t", "y"), df.sparkSession)
    levels = absorbed(free, ["y"], ["i", "t"]).levels
    units, times = (levels[c].select(F.col("__level").alias(c), F.col("e_y").alias(e)) for c, e in (("i", "a"), ("t", "b")))
    treated = p.where("t >= g")
    gaps = treated.join(units, "i", "left").join(times, "t", "left").withColumn("tau", F.col("y") - F.col("a") - F.col("b"))
    if gaps.where("tau is null").limit(1).count():
        raise DataInsufficient("a treated unit or period has no untreated row")
    return gaps.withColumn("e", F.col("t") - F.col("g")).rollup("e").agg(F.avg("tau").alias("att"), F.count("*").alias("n"))


def local_projection_did(df: DataFrame, y: str, first: str, unit: str, time: str, horizons: range = range(-3, 4)) -> DataFrame:
    """(horizon, att, std_error): long differences from the period before treatment on treatment, with clean controls and period effects.

    At horizon h a period's newly treated units meet the units untreated until h periods later; the
    regression with period effects comes from cell sums per period.
    """
    p = _panel(df, y, first, unit, time)
    base = p.select(F.col("i").alias("bi"), (F.col("t") + 1).alias("bt"), F.col("y").alias("y0"))
    start = p.select("i", "t", "g").join(base, (F.col("i") == F.col("bi")) & (F.col("t") == F.col("bt"))).select("i", "t", "g", "y0")
    rows = []
    for h in horizons:
        if h == -1:
            continue
        late = p.select(F.col("i").alias("li"), (F.col("t") - h).alias("lt"), F.col("y").alias("y1"))
        new = F.col("g") == F.col("t")
        d = start.join(late, (F.col("i") == F.col("li")) & (F.col("t") == F.col("lt"))).where(new | F.col("g").isNull() | (F.col("g") > F.col("t") + max(h, 0)))
        d = d.select("t", F.coalesce(new, F.lit(False)).cast("double").alias("d"), (F.col("y1") - F.col("y0")).alias("dy"))
        per = d.groupBy("t").agg(F.count("*").alias("n"), F.covar_pop("d", "dy").alias("c"), F.var_pop("d").alias("v"), F.var_pop("dy").alias("q")).where("v > 0")
        n, c, v, q, k = per.agg(F.sum("n"), F.sum(F.col("n") * F.col("c")), F.sum(F.col("n") * F.col("v")), F.sum(F.col("n") * F.col("q")), F.count("*")).first()
        if v:
            b, free = c / v, n - k - 1
            rows.append((h, b, math.sqrt(max(q - b * c, 0.0) / free / v) if free > 0 else math.nan))
    return df.sparkSession.createDataFrame(rows, "horizon int, att double, std_error double")


def pretrends(df: DataFrame, y: str, first: str, unit: str, time: str, window: tuple[int, int] = (-4, 4)) -> dict[str, float]:
    """Joint Wald test that the event-time effects before treatment are zero."""
    fit = event_study(df, y, first, unit, time, window)
    at = [i for i, name in enumerate(fit.names) if name.startswith("e-")]
    if not at:
        raise DataInsufficient("no period before the reference")
    b, v = fit.beta[at], fit.vcov[np.ix_(at, at)]
    stat = float(b @ np.linalg.pinv(v) @ b)
    return {"chi2": stat, "df": len(at), "p_value": dist.chi2_sf(stat, len(at))}
