"""Classical tests of location, spread, distribution and association, from grouped moments and ranks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import num
from abacist.operators.core import DataInsufficient, running


def _groups(df: DataFrame, y: str, group: str) -> list:
    """(group, n, mean, sample variance); one row per group."""
    d = df.select(F.col(group).alias("g"), num(y).alias("y")).dropna()
    return d.groupBy("g").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_samp("y").alias("v")).orderBy("g").collect()


def t_test(df: DataFrame, y: str, group: str, equal_variances: bool = False) -> dict[str, float]:
    """Second group less first, Welch's or the pooled test."""
    rows = _groups(df, y, group)
    if len(rows) != 2 or min(r.n for r in rows) < 2:
        raise DataInsufficient("two groups of two rows or more are needed")
    a, b = rows
    if equal_variances:
        free = a.n + b.n - 2
        se = math.sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / free * (1 / a.n + 1 / b.n))
    else:
        va, vb = a.v / a.n, b.v / b.n
        se = math.sqrt(va + vb)
        free = (va + vb) ** 2 / (va * va / (a.n - 1) + vb * vb / (b.n - 1))
    t = (b.m - a.m) / se
    return {"difference": b.m - a.m, "std_error": se, "t": t, "df": free, "p_value": dist.two_sided(t, free)}


def anova(df: DataFrame, y: str, group: str) -> dict[str, float]:
    """One-way analysis of variance."""
    rows = _groups(df, y, group)
    n, k = sum(r.n for r in rows), len(rows)
    if k < 2 or n <= k:
        raise DataInsufficient("two groups and more rows than groups are needed")
    mean = sum(r.n * r.m for r in rows) / n
    between = sum(r.n * (r.m - mean) ** 2 for r in rows)
    within = sum((r.n - 1) * (r.v or 0.0) for r in rows)
    f = between / (k - 1) / (within / (n - k))
    return {"f": f, "df1": k - 1, "df2": n - k, "p_value": dist.f_sf(f, k - 1, n - k), "eta_squared": between / (between + within)}


def levene(df: DataFrame, y: str, group: str) -> dict[str, float]:
    """Equal spread: analysis of variance of the distances from the group means."""
    d = df.select(F.col(group).alias("g"), num(y).alias("y")).dropna()
    m = d.groupBy("g").agg(F.avg("y").alias("m")).withColumnRenamed("g", "h")
    return anova(d.join(m, d["g"] == m["h"]).select("g", F.abs(F.col("y") - F.col("m")).alias("away")), "away", "g")


def bartlett(df: DataFrame, y: str, group: str) -> dict[str, float]:
    """Equal variances of normal groups."""
    rows = _groups(df, y, group)
    n, k = sum(r.n for r in rows), len(rows)
    pooled = sum((r.n - 1) * r.v for r in rows) / (n - k)
    stat = (n - k) * math.log(pooled) - sum((r.n - 1) * math.log(r.v) for r in rows)
    stat /= 1 + (sum(1 / (r.n - 1) for r in rows) - 1 / (n - k)) / (3 * (k - 1))
    return {"chi2": stat, "df": k - 1, "p_value": dist.chi2_sf(stat, k - 1)}


def kruskal(df: DataFrame, y: str, group: str) -> dict[str, float]:
    """Kruskal and Wallis' rank test with the correction for ties; with two groups it is the rank-sum test."""
    d = df.select(F.col(group).alias("g"), num(y).alias("y")).dropna()
    cells = d.groupBy("y", "g").agg(F.count("*").alias("n"))
    per = running(cells.groupBy("y").agg(F.sum("n").alias("all")), "y", {"n": F.col("all")})
    ranks = per.select(F.col("y").alias("__y"), (F.col("run_n") - (F.col("all") - 1) / 2).alias("rank"))
    rows = cells.join(ranks, cells["y"] == ranks["__y"]).groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r")).collect()
    tied = per.agg(F.sum(F.col("all").cast("double") ** 3 - F.col("all"))).first()[0] or 0.0
    n, k = sum(r.n for r in rows), len(rows)
    if k < 2:
        raise DataInsufficient("two groups are needed")
    h = 12 / (n * (n + 1)) * sum(r.r**2 / r.n for r in rows) - 3 * (n + 1)
    h /= 1 - tied / (float(n) ** 3 - n)
    return {"h": h, "df": k - 1, "p_value": dist.chi2_sf(h, k - 1)}


def rank_sum(df: DataFrame, y: str, group: str) -> dict[str, float]:
    """Mann and Whitney's U of the higher group, with its z (ties corrected) and the chance that it is the larger."""
    d = df.select(F.col(group).alias("g"), num(y).alias("y")).dropna()
    low, high = d.agg(F.min("g"), F.max("g")).first()
    per = d.groupBy("y").agg(F.count(F.when(F.col("g") == F.lit(high), 1)).alias("b"), F.count(F.when(F.col("g") == F.lit(low), 1)).alias("a"))
    per = running(per, "y", {"a": F.col("a")})
    size = (F.col("a") + F.col("b")).cast("double")
    u, a, b, tied = per.agg(F.sum(F.col("b") * (F.col("run_a") - F.col("a") / 2)), F.sum("a"), F.sum("b"), F.sum(size**3 - size)).first()
    n = a + b
    var = a * b / 12 * (n + 1 - tied / (n * (n - 1)))
    z = (u - a * b / 2) / math.sqrt(var)
    return {"u": u, "z": z, "p_value": dist.two_sided(z), "superiority": u / (a * b)}


def kolmogorov_smirnov(df: DataFrame, y: str, group: str) -> dict[str, float]:
    """Largest distance of two groups' distribution functions; asymptotic p-value."""
    d = df.select(F.col(group).alias("g"), num(y).alias("y")).dropna()
    low, high = d.agg(F.min("g"), F.max("g")).first()
    per = d.groupBy("y").agg(*[F.count(F.when(F.col("g") == F.lit(v), 1)).alias(c) for c, v in (("a", low), ("b", high))])
    per = running(per, "y", {"a": F.col("a"), "b": F.col("b")})
    gap, a, b = per.agg(F.max(F.abs(F.col("run_a") / F.col("all_a") - F.col("run_b") / F.col("all_b"))), F.max("all_a"), F.max("all_b")).first()
    x = gap * math.sqrt(a * b / (a + b))
    p = 2 * sum((-1) ** (i - 1) * math.exp(-2 * i * i * x * x) for i in range(1, 101)) if x > 0.2 else 1.0
    return {"d": gap, "p_value": min(1.0, max(0.0, p))}


def spearman(df: DataFrame, x: str, y: str) -> dict[str, float]:
    """Rank correlation; ties share their mean rank."""
    from abacist.operators.describe import ranked

    d = df.select(num(x).alias("x"), num(y).alias("y")).dropna()
    r, n = ranked(ranked(d, "x", {"rx": "average"}), "y", {"ry": "average"}).agg(F.corr("rx", "ry"), F.count("*")).first()
    t = r * math.sqrt((n - 2) / (1 - r * r)) if abs(r) < 1 else math.inf
    return {"rho": r, "n": n, "p_value": dist.two_sided(t, n - 2)}


def mcnemar(df: DataFrame, first: str, second: str) -> dict[str, float]:
    """Equal margins of two paired 0/1 columns, with the continuity correction."""
    d = df.select(num(first).alias("a"), num(second).alias("b")).dropna()
    b, c = d.agg(F.count(F.when((F.col("a") == 1) & (F.col("b") == 0), 1)), F.count(F.when((F.col("a") == 0) & (F.col("b") == 1), 1))).first()
    stat = max(abs(b - c) - 1, 0) ** 2 / (b + c) if b + c else 0.0
    return {"chi2": stat, "p_value": dist.chi2_sf(stat, 1), "odds_ratio": b / c if c else math.inf}


def trend(df: DataFrame, outcome: str, dose: str) -> dict[str, float]:
    """Cochran and Armitage's linear trend of a 0/1 outcome over ordered doses."""
    d = df.select(num(outcome).alias("y"), num(dose).alias("x")).dropna()
    n, p, xy, mx, vx = d.agg(F.count("*"), F.avg("y"), F.covar_pop("x", "y"), F.avg("x"), F.var_pop("x")).first()
    if not vx or p in (0.0, 1.0):
        raise DataInsufficient("doses and outcomes must vary")
    z = xy * math.sqrt(n / (p * (1 - p) * vx))
    return {"z": z, "slope": xy / vx, "p_value": dist.two_sided(z)}

