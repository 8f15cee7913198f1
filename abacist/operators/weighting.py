"""Weighting, coarsened matching and distributional effects, from cells and from running sums over distinct values."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import num
from abacist.operators.core import DataInsufficient, Fit, names_of, quantiles, running, usable


def weighted_quantiles(df: DataFrame, y: str, weight: str, quantiles: list[float], by: list[str] = []) -> DataFrame:
    """(by, quantile, value): the smallest value whose cumulative share of the weight reaches each quantile."""
    v = df.select(*by, num(y).alias("y"), num(weight).alias("w")).where("y is not null and w > 0").groupBy(*by, "y").agg(F.sum("w").alias("w"))
    v = running(v, "y", {"w": F.col("w")}, by)
    share = F.round(F.col("run_w") / F.col("all_w"), 12)
    one = v.groupBy(*by).agg(*[F.min(F.when(share >= q, F.col("y"))).alias(f"q{i}") for i, q in enumerate(quantiles)])
    return one.select(*by, F.explode(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.col(f"q{i}").alias("value")) for i, q in enumerate(quantiles)])).alias("r")).select(*by, "r.quantile", "r.value")


def cell_weights(df: DataFrame, arm: str, cells: list[str]) -> DataFrame:
    """Adds ``weight``, the inverse share of the row's arm in its cell; cells that lack an arm go.

    Any number of arms; propensities are saturated in the cells, which are joined to the rows as
    aggregated counts.
    """
    d = df.dropna(subset=[arm, *cells])
    n = d.groupBy(*cells, arm).agg(F.count("*").alias("__n"))
    arms = d.select(arm).distinct().count()
    whole = n.groupBy(*cells).agg(F.sum("__n").alias("__all"), F.count("*").alias("__arms")).where(F.col("__arms") == arms)
    share = n.join(whole, cells).withColumn("weight", F.col("__all") / F.col("__n")).select(*cells, arm, "weight")
    return d.join(share, [*cells, arm])


def multi_arm(df: DataFrame, y: str, arm: str, cells: list[str]) -> DataFrame:
    """Weighted mean of y under each arm (normalised weights) with its influence-function error, over the common cells."""
    d = cell_weights(df.where(num(y).isNotNull()), arm, cells)
    m = d.groupBy(F.col(arm).alias("arm")).agg((F.sum(F.col("weight") * num(y)) / F.sum("weight")).alias("mean"), F.sum("weight").alias("total"), F.count("*").alias("n"))
    j = d.select(F.col(arm).alias("__arm"), num(y).alias("__y"), "weight").join(m, F.col("__arm") == F.col("arm"))
    e = F.col("weight") * (F.col("__y") - F.col("mean")) / F.col("total")
    return j.groupBy("arm").agg(F.max("mean").alias("mean"), F.sqrt(F.sum(e * e)).alias("std_error"), F.max("n").alias("n"))


def quantile_effects(df: DataFrame, y: str, treat: str, cells: list[str], quantiles: list[float] = [0.25, 0.5, 0.75]) -> DataFrame:
    """Effects on quantiles of the whole population: differences of inverse-weighted quantiles."""
    q = weighted_quantiles(cell_weights(df, treat, cells).withColumn("__t", num(treat)), y, "weight", quantiles, ["__t"])
    one = q.groupBy("quantile").agg(F.max(F.when(F.col("__t") == 1, F.col("value"))).alias("treated"), F.max(F.when(F.col("__t") == 0, F.col("value"))).alias("control"))
    return one.withColumn("effect", F.col("treated") - F.col("control"))


def coarsened_matching(df: DataFrame, y: str, treat: str, cells: list[str]) -> dict[str, float]:
    """Effect on the treated by exact matching in coarsened cells; cells without both arms go."""
    d = df.select(*cells, num(treat).alias("t"), num(y).alias("y")).dropna()
    t1, t0 = (F.col("t") == 1), (F.col("t") == 0)
    agg = [F.count(F.when(t1, 1)).alias("n1"), F.count(F.when(t0, 1)).alias("n0"), F.avg(F.when(t1, F.col("y"))).alias("m1"), F.avg(F.when(t0, F.col("y"))).alias("m0")]
    agg += [F.coalesce(F.var_samp(F.when(t, F.col("y"))), F.lit(0.0)).alias(v) for t, v in ((t1, "v1"), (t0, "v0"))]
    c = d.groupBy(*cells).agg(*agg)
    both = c.where("n1 > 0 and n0 > 0")
    r = both.agg(F.sum(F.col("n1") * (F.col("m1") - F.col("m0"))), F.sum("n1"), F.sum("n0"), F.sum(F.col("n1") ** 2 * (F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))), F.count("*")).first()
    if not r[1]:
        raise DataInsufficient("no cell has both arms")
    every = c.agg(F.sum("n1"), F.sum("n0")).first()
    return {"att": r[0] / r[1], "std_error": math.sqrt(r[3]) / r[1], "cells": r[4], "treated": r[1], "controls": r[2], "treated_unmatched": every[0] - r[1], "controls_unmatched": every[1] - r[2]}


def subclassification(df: DataFrame, y: str, treat: str, score: str, classes: int = 5) -> dict[str, float]:
    """Average effect over classes of equal size by a score, cut at exact quantiles."""
    from abacist.operators.tabulate import quantile_groups

    d = quantile_groups(df.select(num(y).alias("y"), num(treat).alias("t"), num(score).alias("s")).dropna(), "s", classes, "class")
    t1, t0 = (F.col("t") == 1), (F.col("t") == 0)
    c = d.groupBy("class").agg(F.count("*").alias("n"), *[f(F.when(t, F.col("y"))).alias(a) for t, i in ((t1, 1), (t0, 0)) for f, a in ((F.avg, f"m{i}"), (F.var_samp, f"v{i}"), (F.count, f"n{i}"))]).where("n1 > 1 and n0 > 1")
    total, e, v, k = c.agg(F.sum("n"), F.sum(F.col("n") * (F.col("m1") - F.col("m0"))), F.sum(F.col("n") ** 2 * (F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))), F.count("*")).first()
    if not total:
        raise DataInsufficient("no class has two rows of each arm")
    return {"ate": e / total, "std_error": math.sqrt(v) / total, "classes": k}


def overlap(df: DataFrame, treat: str, score: str, bins: int = 20) -> DataFrame:
    """Share of each arm's rows per bin of a score between 0 and 1."""
    d = df.select(num(treat).alias("t"), num(score).alias("s")).dropna()
    n = d.agg(F.sum("t"), F.count("*")).first()
    at = F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).alias("bin")
    return d.groupBy(at).agg((F.sum("t") / n[0]).alias("treated"), (F.sum(1 - F.col("t")) / (n[1] - n[0])).alias("control"))


def crump_cut(df: DataFrame, score: str, steps: int = 500) -> float:
    """The smallest trimming bound a for which the precision condition holds on [a, 1 - a], from a histogram of the score.

    The condition is checked at ``steps`` bounds between 0 and one half.
    """
    g = 1 / (num(score) * (1 - num(score)))
    d = df.select(g.alias("g"), F.least(num(score), 1 - num(score)).alias("m")).where("g is not null and m > 0")
    cell = F.least(F.floor(F.col("m") * 2 * steps), F.lit(steps - 1)).cast("int")
    per = {r[0]: (r[1], r[2]) for r in d.groupBy(cell).agg(F.count("*"), F.sum("g")).collect()}  # at most ``steps`` rows
    n = total = 0.0
    for i in reversed(range(steps)):
        n, total = n + per.get(i, (0, 0.0))[0], total + per.get(i, (0, 0.0))[1]
        a = i / (2 * steps)
        if a > 0 and n and 1 / (a * (1 - a)) > 2 * total / n:
            return round((i + 1) / (2 * steps), 9)
    return 0.0


def transport(df: DataFrame, y: str, treat: str, sample: str, cells: list[str]) -> dict[str, float]:
    """Effect in a target population: the trial's cell effects weighted by the target's cell counts (``sample`` 1 trial, 0 target)."""
    d = df.select(*cells, num(sample).alias("s"), num(treat).alias("t"), num(y).alias("y")).where("s is not null").dropna(subset=cells)
    t1, t0 = ((F.col("s") == 1) & (F.col("t") == v) & F.col("y").isNotNull() for v in (1, 0))
    c = d.groupBy(*cells).agg(F.count(F.when(F.col("s") == 0, 1)).alias("n"), *[f(F.when(t, F.col("y"))).alias(a) for t, i in ((t1, 1), (t0, 0)) for f, a in ((F.avg, f"m{i}"), (F.var_samp, f"v{i}"), (F.count, f"n{i}"))])
    ok = (F.col("n1") > 0) & (F.col("n0") > 0)
    effect = F.when(ok, F.col("n") * (F.col("m1") - F.col("m0")))
    var = F.when(ok, F.col("n") ** 2 * (F.coalesce("v1", F.lit(0.0)) / F.col("n1") + F.coalesce("v0", F.lit(0.0)) / F.col("n0")))
    e, v, n, every = c.agg(F.sum(effect), F.sum(var), F.sum(F.when(ok, F.col("n"))), F.sum("n")).first()
    if not n:
        raise DataInsufficient("no cell of the target has both arms in the trial")
    return {"effect": e / n, "std_error": math.sqrt(v) / n, "covered": n / every}


def doubly_robust_value(df: DataFrame, reward: str, action: str, propensity: str, policy, cells: list[str]) -> dict[str, float]:
    """Value of a policy from logged actions: direct method (cell means) and doubly robust."""
    d = df.select(*cells, num(reward).alias("r"), F.col(action).alias("a"), policy.alias("p"), num(propensity).alias("e")).dropna()
    q = d.groupBy(*[F.col(c).alias(f"__c_{c}") for c in cells], F.col("a").alias("__a")).agg(F.avg("r").alias("q"))
    met = lambda a: reduce(lambda x, z: x & z, [d[c] == q[f"__c_{c}"] for c in cells], d[a] == q["__a"])
    j = d.join(q, met("p"), "left").select(*d.columns, F.coalesce("q", F.lit(0.0)).alias("q"))
    dr = F.col("q") + F.when(F.col("a") == F.col("p"), (F.col("r") - F.col("q")) / F.col("e")).otherwise(0.0)
    r = j.agg(F.avg("q"), F.avg(dr), F.stddev(dr), F.count("*")).first()
    return {"direct": r[0], "doubly_robust": r[1], "std_error": r[2] / math.sqrt(r[3])}


def changes_in_changes(df: DataFrame, y: str, treat: str, post: str) -> dict[str, float]:
    """Athey and Imbens' effect on the treated: treated outcomes before, moved through the controls' change of distribution.

    Each distribution is a table of distinct values; the quantile map is a running minimum over the
    probabilities of two of them.
    """
    d = df.select(num(y).alias("y"), num(treat).alias("g"), num(post).alias("t")).dropna()
    v = d.groupBy("g", "t", "y").agg(F.count("*").alias("n"))
    before = v.where("g = 0 and t = 0").select("y", F.col("n").alias("n0"), F.lit(0).alias("n1")).unionByName(v.where("g = 1 and t = 0").select("y", F.lit(0).alias("n0"), F.col("n").alias("n1")))
    before = running(before.groupBy("y").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "y", {"n0": F.col("n0")})
    asked = before.where("n1 > 0").select(F.round(F.col("run_n0") / F.col("all_n0"), 12).alias("p"), F.col("n1").alias("n"), F.lit(None).cast("double").alias("y"))
    after = running(v.where("g = 0 and t = 1").select("y", "n"), "y", {"n": F.col("n")})
    known = after.select(F.round(F.col("run_n") / F.col("all_n"), 12).alias("p"), F.lit(0).alias("n"), "y")
    steps = asked.unionByName(known).groupBy("p").agg(F.sum("n").alias("n"), F.min("y").alias("y"))
    steps = running(steps, "p", {"y": F.col("y")}, down=True, fn="min")
    moved, n = steps.agg(F.sum(F.col("n") * F.col("run_y")), F.sum("n")).first()
    actual = d.where("g = 1 and t = 1").agg(F.avg("y")).first()[0]
    return {"att": actual - moved / n, "counterfactual": moved / n, "actual": actual}


def switchers(df: DataFrame, y: str, d: str, unit: str, time: str) -> DataFrame:
    """Per period: how outcomes change for units that switch treatment on (off), against units that keep theirs; de Chaisemartin and D'Haultfoeuille's cells."""
    w = Window.partitionBy("u").orderBy("t")
    p = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), num(y).alias("y"), num(d).alias("d")).dropna()
    p = p.select("t", (F.col("y") - F.lag("y").over(w)).alias("dy"), F.lag("d").over(w).alias("before"), "d").where("dy is not null")
    per = p.groupBy("t", F.col("before").alias("from")).agg(F.count(F.when(F.col("d") != F.col("before"), 1)).alias("switch"), F.count(F.when(F.col("d") == F.col("before"), 1)).alias("stay"), F.avg(F.when(F.col("d") != F.col("before"), F.col("dy"))).alias("m1"), F.avg(F.when(F.col("d") == F.col("before"), F.col("dy"))).alias("m0"))
    sign = F.when(F.col("from") == 0, 1.0).otherwise(-1.0)
    return per.where("switch > 0 and stay > 0").select(F.col("t").alias("time"), "from", "switch", "stay", (sign * (F.col("m1") - F.col("m0"))).alias("effect"))


def relative_magnitude(estimates: dict[int, float], errors: dict[int, float], bound: float = 1.0, reference: int = -1, alpha: float = 0.05) -> list[tuple]:
    """Bounds of post-period effects if trends may break by ``bound`` times the largest break before treatment: (period, low, high, ci_low, ci_high)."""
    path = {**estimates, reference: 0.0}
    before = sorted(k for k in path if k <= reference)
    worst = max((abs(path[b] - path[a]) for a, b in zip(before, before[1:])), default=0.0)
    z = dist.norm_ppf(1 - alpha / 2)
    return [(k, v - bound * worst * (k - reference), v + bound * worst * (k - reference), v - bound * worst * (k - reference) - z * errors[k], v + bound * worst * (k - reference) + z * errors[k]) for k, v in sorted(estimates.items()) if k > reference]


def two_stage_g(df: DataFrame, y: str, first: str, second: str, before: list[str], between: list[str]) -> DataFrame:
    """Mean outcome under each pair of treatments at two times, by iterated expectations in cells."""
    d = df.select(*before, *between, num(first).alias("a"), num(second).alias("b"), num(y).alias("y")).dropna()
    inner = d.groupBy(*before, "a", *between, "b").agg(F.avg("y").alias("q"))
    seen = d.groupBy(*before, "a", *between).agg(F.count("*").alias("n"))
    outer = seen.join(inner, [*before, "a", *between]).groupBy(*before, "a", "b").agg((F.sum(F.col("n") * F.col("q")) / F.sum("n")).alias("q"))
    share = d.groupBy(*before).agg(F.count("*").alias("n"))
    return outer.join(share, before).groupBy("a", "b").agg((F.sum(F.col("n") * F.col("q")) / F.sum("n")).alias("mean"))


def q_learning(df: DataFrame, y: str, first: str, second: str, x1: list[str], x2: list[str]) -> dict[str, Fit]:
    """Two-stage regime by backward regressions with treatment interactions; the fits hold each stage's rule."""
    from abacist.operators.regression import ols

    d = usable(df, names_of(list(dict.fromkeys([y, first, second, *x1, *x2]))))
    terms = lambda a, xs: [*xs, a, *[(f"{a}:{c}", F.col(a) * F.col(c)) for c in xs]]
    late = ols(d, y, terms(second, x2))
    gain = F.lit(late[second]) + sum((F.lit(late[f"{second}:{c}"]) * F.col(c) for c in x2), F.lit(0.0))
    best = F.col(y) + F.greatest(gain, F.lit(0.0)) - F.col(second) * gain
    early = ols(d.withColumn("__value", best), "__value", terms(first, x1))
    return {"second": late, "first": early}


def qq(df: DataFrame, y: str, group: str, points: int = 9) -> DataFrame:
    """Quantiles of two groups side by side (exact, linear)."""
    d = df.select(num(y).alias("y"), num(group).alias("g")).dropna()
    at = [i / (points + 1) for i in range(1, points + 1)]
    rows = {r[0]: r[1] for r in quantiles(d.where("g in (0, 1)"), ["y"], at, ["g"]).collect()}  # two groups
    return df.sparkSession.createDataFrame([(a, b, c) for a, b, c in zip(at, rows[0.0], rows[1.0])], "quantile double, group0 double, group1 double")

