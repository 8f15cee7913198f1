"""Bootstrap, permutation, jackknife and multiple testing, as replicate columns instead of refits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import num, poisson1, uniform
from abacist.operators.core import running


def bootstrap(df: DataFrame, statistic, keys: list[str], replicates: int = 200, seed: int = 0) -> DataFrame:
    """(replicate, value) of a weighted statistic.

    ``statistic(weight)`` is an aggregate expression; replicate weights are Poisson(1) draws from a
    hash of the keys (rows or clusters), so no replicate shuffles rows.  Replicates are evaluated a
    few dozen per job, as extra aggregates of one scan.
    """
    out, step = [], 50
    for a in range(0, replicates, step):
        some = range(a, min(a + step, replicates))
        row = df.agg(*[statistic(poisson1(seed, F.lit("bootstrap"), F.lit(b), *[F.col(k) for k in keys]).cast("double")) for b in some]).first()
        out += list(zip(some, row))
    return df.sparkSession.createDataFrame([(b, float(v)) for b, v in out if v is not None], "replicate int, value double")


def weighted_mean(col: str):
    return lambda w: F.sum(w * F.col(col)) / F.sum(w)


def summary(draws: DataFrame, estimate: float, null: float = 0.0, alpha: float = 0.05) -> dict[str, float]:
    """Standard error, percentile interval and the centred p-value."""
    n, sd, q, far = draws.agg(F.count("*"), F.stddev("value"), F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))), F.avg((F.abs(F.col("value") - estimate) >= abs(estimate - null)).cast("double"))).first()
    return {"estimate": estimate, "std_error": sd, "ci_low": q[0], "ci_high": q[1], "p_value": max(far, 1 / (n + 1))}


def permutation(df: DataFrame, y: str, treat: str, key: str, strata: list[str] = [], replicates: int = 200, seed: int = 0) -> dict[str, float]:
    """Randomisation test of the difference of means with re-drawn Bernoulli assignment at each stratum's treated share."""
    d = df.select(num(y).alias("y"), num(treat).alias("t"), F.col(key).alias("k"), *strata).dropna(subset=["y", "t", "k"])
    share = F.avg("t").over(Window.partitionBy(*strata)) if strata else None
    if strata:
        d = d.withColumn("p", share)
    else:
        d = d.withColumn("p", F.lit(d.agg(F.avg("t")).first()[0]))
    gap = lambda t: F.sum(t * F.col("y")) / F.sum(t) - F.sum((1 - t) * F.col("y")) / F.sum(1 - t)
    seen, far, n = d.agg(gap(F.col("t"))).first()[0], 0, 0
    for a in range(0, replicates, 50):
        draws = [(uniform(seed, F.lit("permutation"), F.lit(b), F.col("k")) < F.col("p")).cast("double") for b in range(a, min(a + 50, replicates))]
        got = [v for v in d.agg(*[gap(t) for t in draws]).first() if v is not None]
        far, n = far + sum(abs(v) >= abs(seen) for v in got), n + len(got)
    return {"estimate": seen, "p_value": (far + 1) / (n + 1)}


def jackknife_mean(df: DataFrame, y: str, cluster: str) -> dict[str, float]:
    """Delete-one-cluster jackknife of a mean, from cluster sums."""
    c = df.select(num(y).alias("y"), F.col(cluster).alias("c")).dropna().groupBy("c").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    S, N, G = c.agg(F.sum("s"), F.sum("n"), F.count("*")).first()
    v = c.agg(F.sum(((S - F.col("s")) / (N - F.col("n")) - S / N) ** 2)).first()[0]
    return {"estimate": S / N, "std_error": math.sqrt((G - 1) / G * v), "clusters": float(G)}


def wild_cluster(df: DataFrame, y: str, x: list[str], focus: str, cluster: str, replicates: int = 999, seed: int = 0) -> dict[str, float]:
    """Wild cluster bootstrap-t with the null imposed: Rademacher signs applied to cluster score sums (G small rows)."""
    from abacist.operators.core import names_of, usable
    from abacist.operators.regression import ols

    d = usable(df, names_of([y, *x]), (cluster,))
    full, null = ols(d, y, x, cluster=cluster), ols(d, y, [c for c in x if c != focus])
    cols = {c: F.col(c) for c in x}
    e = F.col(y) - null.predict(cols)
    design = [F.lit(1.0), *[F.col(c) for c in x]]
    k = len(design)
    per = d.groupBy(cluster).agg(*[F.sum(c * e) for c in design], *[F.sum(design[i] * design[j]) for i in range(k) for j in range(k)])
    rows = per.limit(200_001).collect()
    if len(rows) > 200_000:
        raise ValueError("over 200,000 clusters: the clustered standard error needs no bootstrap")
    rows.sort(key=lambda r: str(r[0]))
    s = np.array([r[1 : 1 + k] for r in rows], dtype=float)
    xx = np.array([r[1 + k :] for r in rows], dtype=float).reshape(-1, k, k)
    bread, at, rng = full.extra["bread"], 1 + x.index(focus), np.random.default_rng(seed)
    t0, far = full.beta[at] / full.se[at], 0
    for _ in range(replicates):
        v = s * rng.choice([-1.0, 1.0], len(s))[:, None]
        b = bread @ v.sum(0)
        u = v - xx @ b
        g = len(s)
        se = math.sqrt((bread @ (u.T @ u) @ bread)[at, at] * g / (g - 1))
        far += abs(b[at] / se) >= abs(t0)
    return {"estimate": full[focus], "t": float(t0), "p_value": (far + 1) / (replicates + 1)}


def harmonic(n: int) -> float:
    """1 + 1/2 + ... + 1/n; from 1000 on by its expansion, to the last digits of a double."""
    if n < 1000:
        return math.fsum(1 / i for i in range(1, n + 1))
    return math.log(n) + 0.57721566490153286 + 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4)


def adjust(df: DataFrame, p: str, method: str = "bh") -> DataFrame:
    """Adds ``p_adjusted``: bonferroni, holm, bh or by, as running extremes over the distinct p-values."""
    d = df.where(F.col(p).isNotNull())
    per = running(d.groupBy(num(p).alias("__p")).agg(F.count("*").alias("__n")), "__p", {"n": F.col("__n")})
    value, n = F.col("__p"), F.col("all_n")
    if method == "bonferroni":
        per = per.withColumn("__out", value * n)
    elif method == "holm":  # of equal p-values the first has the largest factor
        per = running(per.select("__p", (value * (n - F.col("run_n") + F.col("__n"))).alias("v")), "__p", {"v": F.col("v")}, fn="max").withColumnRenamed("run_v", "__out")
    else:
        total = 1.0 if method == "bh" else harmonic(d.count())
        per = running(per.select("__p", (value * n / F.col("run_n") * total).alias("v")), "__p", {"v": F.col("v")}, down=True, fn="min").withColumnRenamed("run_v", "__out")
    per = per.select("__p", F.least("__out", F.lit(1.0)).alias("p_adjusted"))
    return d.join(per, num(p) == F.col("__p")).drop("__p")


def combine_p(df: DataFrame, p: str) -> dict[str, float]:
    """Fisher's and Stouffer's combinations."""
    from abacist.functions.dist import chi2_sf

    n, s = df.agg(F.count(p), F.sum(-2 * F.log(p))).first()
    return {"fisher": s, "p_value": chi2_sf(s, 2 * n)}


def sequential_test(df: DataFrame, y: str, order: str, variance: float, tau: float = 1.0) -> DataFrame:
    """Always-valid p-values of a mean by the mixture likelihood ratio, along batches given by ``order``."""
    b = df.groupBy(order).agg(F.sum(num(y)).alias("s"), F.count(num(y)).alias("n"))
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    S, N = F.sum("s").over(w), F.sum("n").over(w)
    v = b.select(order, N.alias("n"), (S / N).alias("mean"))
    ratio = F.sqrt(variance / (variance + F.col("n") * tau)) * F.exp(F.col("n") ** 2 * tau * F.col("mean") ** 2 / (2 * variance * (variance + F.col("n") * tau)))
    return v.withColumn("p_value", F.min(F.least(F.lit(1.0), 1 / ratio)).over(w))
