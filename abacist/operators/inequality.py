"""Inequality, poverty and decompositions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions.columns import num
from abacist.operators.core import grouped_gram, names_of, quantiles, running, solve_ls, usable


def _values(df: DataFrame, y: str, weight: str | None, by: list[str]) -> DataFrame:
    d = df.select(*by, num(y).alias("y"), (num(weight) if weight else F.lit(1.0)).alias("w")).dropna()
    return d.groupBy(*by, "y").agg(F.sum("w").alias("w"))


def gini(df: DataFrame, y: str, weight: str | None = None, by: list[str] = []) -> DataFrame:
    """Gini coefficient per group, from running sums over distinct values."""
    v = _values(df, y, weight, by)
    v = running(v, "y", {"w": F.col("w")}, by).withColumn("mid", F.col("run_w") - F.col("w") / 2)
    return v.groupBy(*by).agg((2 * F.sum(F.col("w") * F.col("y") * F.col("mid")) / (F.sum("w") * F.sum(F.col("w") * F.col("y"))) - 1).alias("gini"))


def lorenz(df: DataFrame, y: str, points: int = 10, weight: str | None = None) -> DataFrame:
    """Cumulative share of y held by the lowest shares of the population."""
    v = _values(df, y, weight, [])
    v = running(v, "y", {"w": F.col("w"), "y": F.col("w") * F.col("y")})
    v = v.select((F.col("run_w") / F.col("all_w")).alias("p"), (F.col("run_y") / F.col("all_y")).alias("share"))
    return v.groupBy(F.ceil(F.round(F.col("p") * points, 9)).alias("bin")).agg(F.max("p").alias("p"), F.max("share").alias("share"))


def entropy(df: DataFrame, y: str, weight: str | None = None, by: list[str] = []) -> DataFrame:
    """Generalised entropy 0, 1 and 2 (mean log deviation, Theil, half squared variation) of positive values."""
    d = df.select(*by, num(y).alias("y"), (num(weight) if weight else F.lit(1.0)).alias("w")).dropna().where("y > 0")
    w, y_ = F.col("w"), F.col("y")
    s = d.groupBy(*by).agg(F.sum(w).alias("n"), (F.sum(w * y_) / F.sum(w)).alias("m"), (F.sum(w * F.log(y_)) / F.sum(w)).alias("l"), (F.sum(w * y_ * F.log(y_)) / F.sum(w)).alias("yl"), (F.sum(w * y_ * y_) / F.sum(w)).alias("y2"))
    return s.select(*by, "n", F.col("m").alias("mean"), (F.log("m") - F.col("l")).alias("mld"), (F.col("yl") / F.col("m") - F.log("m")).alias("theil"), ((F.col("y2") / F.col("m") ** 2 - 1) / 2).alias("ge2"))


def atkinson(df: DataFrame, y: str, epsilon: float = 1.0, by: list[str] = []) -> DataFrame:
    v = F.greatest(num(y), F.lit(1e-12))
    d = df.select(*by, v.alias("y")).dropna()
    level = F.exp(F.avg(F.log("y"))) if epsilon == 1 else F.pow(F.avg(F.pow("y", F.lit(1 - epsilon))), F.lit(1 / (1 - epsilon)))
    return d.groupBy(*by).agg((1 - level / F.avg("y")).alias("atkinson"))


def theil_decompose(df: DataFrame, y: str, group: str) -> DataFrame:
    """Theil index within and between groups."""
    per = entropy(df, y, by=[group])
    t = per.agg(F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col("mean")).alias("all_y"))
    share = F.col("n") * F.col("mean") / F.col("all_y")
    j = per.crossJoin(F.broadcast(t))  # one row
    return j.agg(F.sum(share * F.col("theil")).alias("within"), F.sum(share * F.log(F.col("mean") / (F.col("all_y") / F.col("all_n")))).alias("between")).withColumn("total", F.col("within") + F.col("between"))


def source_decompose(df: DataFrame, sources: list[str]) -> DataFrame:
    """Share of each income source in the inequality (variance) of the total: Shorrocks's rule."""
    total = sum((F.coalesce(num(c), F.lit(0.0)) for c in sources), F.lit(0.0))
    r = df.agg(*[F.covar_pop(F.coalesce(num(c), F.lit(0.0)), total) for c in sources], F.var_pop(total)).first()
    return df.sparkSession.createDataFrame([(c, v / r[-1]) for c, v in zip(sources, r)], "source string, share double")


def poverty(df: DataFrame, y: str, line: float, by: list[str] = []) -> DataFrame:
    """Foster-Greer-Thorbecke headcount, gap and squared gap."""
    gap = F.greatest(F.lit(0.0), (line - num(y)) / line)
    d = df.where(num(y).isNotNull())
    return d.groupBy(*by).agg(F.avg((num(y) < line).cast("double")).alias("headcount"), F.avg(gap).alias("gap"), F.avg(gap * gap).alias("severity"))


def concentration(df: DataFrame, y: str, rank_by: str) -> float:
    """Concentration index of y over the ranking by another variable (ties share their mid rank)."""
    d = df.select(num(y).alias("y"), num(rank_by).alias("r")).dropna().groupBy("r").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    d = running(d, "r", {"n": F.col("n")}).withColumn("mid", F.col("run_n") - F.col("n") / 2)
    s, sy, n = d.agg(F.sum(F.col("s") * F.col("mid")), F.sum("s"), F.sum("n")).first()
    return 2 * s / (n * sy) - 1


def oaxaca(df: DataFrame, y: str, x: list[str], group: str, reference: str = "0") -> DataFrame:
    """Two-fold decomposition of the gap (group 0 less group 1); reference 0, 1, pooled, cotton or reimers."""
    d = usable(df, names_of([y, x[0], *x[1:], group]))
    names = [y, *x]
    g = grouped_gram(d, names, [group])
    if set(k[0] for k in g) != {0.0, 1.0}:
        raise ValueError("group must be 0/1")
    a, b = g[0.0,], g[1.0,]
    ix = list(range(1, len(names)))
    ba, bb = solve_ls(a, 0, ix)[0], solve_ls(b, 0, ix)[0]
    xa, xb = np.concatenate([[1], a.mean[1:]]), np.concatenate([[1], b.mean[1:]])
    if reference == "pooled":
        from abacist.operators.core import gram

        ref = solve_ls(gram(d, names), 0, ix)[0]
    else:
        w = {"0": 1.0, "1": 0.0, "cotton": a.n / (a.n + b.n), "reimers": 0.5}[reference]
        ref = w * ba + (1 - w) * bb
    explained = (xa - xb) * ref
    unexplained = xa * (ba - ref) + xb * (ref - bb)
    rows = [(n, float(e), float(u)) for n, e, u in zip(["Intercept", *x], explained, unexplained)]
    return df.sparkSession.createDataFrame([*rows, ("total", float(explained.sum()), float(unexplained.sum()))], "term string, explained double, unexplained double")


def kitagawa(df: DataFrame, y: str, cell: str, group: str) -> DataFrame:
    """Rate and composition effects of the gap between two groups coded 0/1."""
    d = df.select(num(y).alias("y"), F.col(cell).alias("c"), num(group).alias("g")).dropna()
    n = lambda v: F.count(F.when(F.col("g") == v, 1))
    per = d.groupBy("c").agg(n(0).alias("n0"), n(1).alias("n1"), F.avg(F.when(F.col("g") == 0, F.col("y"))).alias("r0"), F.avg(F.when(F.col("g") == 1, F.col("y"))).alias("r1"))
    tot = per.agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"))
    j = per.fillna(0.0, ["r0", "r1"]).crossJoin(F.broadcast(tot))  # one row
    s0, s1 = F.col("n0") / F.col("all0"), F.col("n1") / F.col("all1")
    return j.agg(F.sum((F.col("r1") - F.col("r0")) * (s0 + s1) / 2).alias("rate_effect"), F.sum((s1 - s0) * (F.col("r0") + F.col("r1")) / 2).alias("composition_effect"), (F.sum(s1 * F.col("r1")) - F.sum(s0 * F.col("r0"))).alias("gap"))


def rif_regression(df: DataFrame, y: str, x: list[str], quantile: float = 0.5, **how):
    """Unconditional quantile regression: least squares on the recentred influence function."""
    from abacist.operators.regression import ols

    d = usable(df, names_of([y, *x]))
    n, sd = d.agg(F.count("*"), F.stddev(y)).first()
    q, low, high = quantiles(d, [y], [quantile, 0.25, 0.75]).first()[0]
    h = 0.9 * min(sd, (high - low) / 1.349 or sd) * n**-0.2
    z = (F.col(y) - q) / h
    f = d.agg(F.avg(F.exp(-z * z / 2)) / (h * math.sqrt(2 * math.pi))).first()[0]
    rif = q + (quantile - (F.col(y) <= q).cast("double")) / f
    return ols(d, ("rif", rif), x, **how)


def gelbach(df: DataFrame, y: str, focus: str, added: list[str]) -> DataFrame:
    """How much each added covariate moves the coefficient of ``focus`` (order does not matter)."""
    from abacist.operators.core import gram

    names = [y, focus, *added]
    g = gram(usable(df, names_of(names)), names)
    full = solve_ls(g, 0, list(range(1, len(names))))[0]
    short = solve_ls(g, 0, [1])[0]
    rows = [(a, float(solve_ls(g, i, [1])[0][1] * full[i])) for i, a in enumerate(added, 2)]
    return df.sparkSession.createDataFrame([*rows, ("total", float(short[1] - full[1]))], "term string, contribution double")


def dfl(df: DataFrame, y: str, x: list[str], group: str, quantiles: list[float] = [0.1, 0.5, 0.9]) -> DataFrame:
    """Reweighting: quantiles of group 0 with the covariates of group 1, from a logit of the group."""
    from abacist.operators.regression import glm, predicted

    d = usable(df, names_of([y, *x, group]))
    fit = glm(d, group, x, family="logit")
    p = predicted(fit, {c: F.col(c) for c in x})
    w = F.when(F.col(group) == 0, p / (1 - p)).otherwise(1.0)
    d = d.select(y, F.col(group).alias("g"), w.alias("w"))
    out = []
    for name, part, weight in (("group0", d.where("g = 0"), None), ("counterfactual", d.where("g = 0"), "w"), ("group1", d.where("g = 1"), None)):
        v = part.groupBy(y).agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("w"))
        v = running(v, y, {"w": F.col("w")}).withColumn("p", F.col("run_w") / F.col("all_w"))
        r = v.agg(*[F.min(F.when(F.col("p") >= q, F.col(y))) for q in quantiles]).first()
        out += [(name, q, float(x_)) for q, x_ in zip(quantiles, r)]
    return df.sparkSession.createDataFrame(out, "distribution string, quantile double, value double")


def dominance(df: DataFrame, y: str, group: str) -> dict[str, float]:
    """Stochastic dominance of group 1 over group 0: the largest and smallest gap of distribution functions and of their integrals.

    Group 1 dominates to first order if no gap is above 0, to second order if no integral is.
    """
    d = df.select(num(y).alias("y"), num(group).alias("g")).dropna()
    v = running(d.groupBy("y").agg(F.sum("g").alias("b"), F.sum(1 - F.col("g")).alias("a"), F.sum(F.col("g") * F.col("y")).alias("yb"), F.sum((1 - F.col("g")) * F.col("y")).alias("ya")), "y", {c: F.col(c) for c in ("a", "b", "ya", "yb")})
    fa, fb = F.col("run_a") / F.col("all_a"), F.col("run_b") / F.col("all_b")
    gap = fb - fa
    area = gap * F.col("y") - (F.col("run_yb") / F.col("all_b") - F.col("run_ya") / F.col("all_a"))  # integral of the gap up to y
    r = v.agg(F.max(gap), F.min(gap), F.max(area), F.min(area)).first()
    return dict(zip(("first_max", "first_min", "second_max", "second_min"), r))


def quantile_gap(df: DataFrame, y: str, x: list[str], group: str, quantile: float = 0.5) -> DataFrame:
    """Two-fold decomposition of the gap of a quantile: recentered influence functions per group, then Oaxaca's."""
    d = usable(df, names_of([y, *x, group]))
    cuts = {r[0]: r[1] for r in quantiles(d.where(F.col(group).isin(0, 1)), [y], [quantile, 0.25, 0.75], [group]).collect()}  # two groups
    parts = []
    for g in (0, 1):
        own = d.where(F.col(group) == g)
        sd, n = own.agg(F.stddev(y), F.count("*")).first()
        q, low, high = cuts[g]
        h = 0.9 * min(sd, (high - low) / 1.349 or sd) * n**-0.2
        z = (F.col(y) - q) / h
        density = own.agg(F.avg(F.exp(-z * z / 2)) / (h * math.sqrt(2 * math.pi))).first()[0]
        parts.append(own.withColumn("rif", F.lit(q) + (quantile - (F.col(y) <= q).cast("double")) / density))
    return oaxaca(parts[0].unionByName(parts[1]), "rif", x, group)
