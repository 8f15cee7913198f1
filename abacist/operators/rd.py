"""Regression discontinuity, kinks, density tests and bunching."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import kernel, num
from abacist.operators.core import DataInsufficient, inverse, usable


def _sides(d: DataFrame, h: float, order: int, kern: str, value: str = "y") -> dict[int, tuple]:
    """Local polynomial per side in one aggregation: (beta, variance with HC1, n), x scaled by h."""
    u = F.col("x") / h
    k = order + 1
    f = d.where(F.abs("x") <= h).withColumns({"__w": kernel(u, kern), "__s": (F.col("x") >= 0).cast("int"), "__u": u}).where("__w > 0")
    p = [F.pow("__u", F.lit(i)) if i else F.lit(1.0) for i in range(2 * order + 1)]
    rows = f.groupBy("__s").agg(F.count("*").alias("n"), *[F.sum(F.col("__w") * q) for q in p], *[F.sum(F.col("__w") * p[i] * F.col(value)) for i in range(k)]).collect()
    fits = {}
    for r in rows:
        s, v = r[2 : 2 + len(p)], np.array(r[2 + len(p) :])
        if r.n <= k:
            raise DataInsufficient("too few rows within the bandwidth")
        bread = inverse(np.array([[s[i + j] for j in range(k)] for i in range(k)]))
        fits[r[0]] = (bread @ v, bread, r.n)
    if set(fits) != {0, 1}:
        raise DataInsufficient("both sides need rows")
    fitted = F.when(F.col("__s") == 1, sum((F.lit(b) * q for b, q in zip(fits[1][0].tolist(), p)), F.lit(0.0))).otherwise(sum((F.lit(b) * q for b, q in zip(fits[0][0].tolist(), p)), F.lit(0.0)))
    e = F.col("__w") * (F.col(value) - fitted)
    meat = {r[0]: r[1:] for r in f.groupBy("__s").agg(*[F.sum(e * e * p[i] * p[j]) for i in range(k) for j in range(k)]).collect()}
    return {s: (b, bread @ np.array(meat[s]).reshape(k, k) @ bread * n / (n - k), n) for s, (b, bread, n) in fits.items()}


def rule_of_thumb(d: DataFrame) -> float:
    """Pilot bandwidth: 1.84 sd n^(-1/5)."""
    n, sd = d.agg(F.count("*"), F.stddev("x")).first()
    return 1.84 * sd * n**-0.2


def rd(df: DataFrame, y: str, running: str, cutoff: float = 0.0, bandwidth: float | None = None, order: int = 1, kern: str = "triangular", fuzzy: str | None = None, derivative: int = 0) -> dict[str, float]:
    """Jump at the cutoff by local polynomials; ``fuzzy`` divides by the jump of a treatment, ``derivative`` 1 is a kink."""
    cols = {"y": F.col(y), "x": num(running) - cutoff, **({"t": F.col(fuzzy)} if fuzzy else {})}
    d = usable(df, cols)
    h = bandwidth or rule_of_thumb(d)
    f = _sides(d, h, order, kern)
    scale = math.factorial(derivative) / h**derivative
    jump = float(f[1][0][derivative] - f[0][0][derivative]) * scale
    var = float(f[1][1][derivative, derivative] + f[0][1][derivative, derivative]) * scale**2
    out = {"n_left": float(f[0][2]), "n_right": float(f[1][2]), "bandwidth": h}
    if fuzzy:
        t = _sides(d, h, order, kern, "t")
        first = float(t[1][0][derivative] - t[0][0][derivative]) * scale
        late = jump / first
        r = _sides(d.withColumn("r", F.col("y") - late * F.col("t")), h, order, kern, "r")
        var = float(r[1][1][derivative, derivative] + r[0][1][derivative, derivative]) * scale**2 / first**2
        jump, out["first_stage"] = late, first
    se = math.sqrt(var)
    z = dist.norm_ppf(0.975)
    return {"estimate": jump, "std_error": se, "p_value": dist.two_sided(jump / se) if se else math.nan, "ci_low": jump - z * se, "ci_high": jump + z * se, **out}


def rd_plot(df: DataFrame, y: str, running: str, cutoff: float = 0.0, bins: int = 20) -> DataFrame:
    """Means in equal-width bins on each side."""
    d = usable(df, {"y": F.col(y), "x": num(running) - cutoff})
    lo, hi = d.agg(F.min("x"), F.max("x")).first()
    side = F.when(F.col("x") >= 0, 1).otherwise(0)
    bin_ = F.when(F.col("x") >= 0, F.least(F.floor(F.col("x") / (hi / bins)), F.lit(bins - 1))).otherwise(F.greatest(F.floor(F.col("x") / (-lo / bins)), F.lit(-bins)))
    return d.groupBy(side.alias("side"), bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def density_test(df: DataFrame, running: str, cutoff: float = 0.0, bandwidth: float | None = None, bins: int = 200) -> dict[str, float]:
    """Jump of the log density at the cutoff: local linear fits to a histogram that respects the cutoff."""
    d = usable(df, {"x": num(running) - cutoff})
    n, sd = d.agg(F.count("*"), F.stddev("x")).first()
    h = bandwidth or 1.84 * sd * n**-0.2 * 2
    w = h / (bins / 2)
    c = d.where(F.abs("x") < h).groupBy(F.floor(F.col("x") / w).alias("b")).agg(F.count("*").alias("n")).collect()
    half = bins // 2
    count = {r.b: r.n for r in c if -half <= r.b < half}
    est = {}
    for side, bs in ((0, range(-half, 0)), (1, range(half))):
        x = np.array([(b + 0.5) * w for b in bs])
        v = np.array([count.get(b, 0) / (n * w) for b in bs])
        k = np.maximum(1 - np.abs(x) / h, 0)
        X = np.column_stack([np.ones_like(x), x])
        est[side] = float(np.linalg.solve(X.T @ (X * k[:, None]), X.T @ (k * v))[0])
    if min(est.values()) <= 0:
        raise DataInsufficient("no density next to the cutoff")
    theta = math.log(est[1]) - math.log(est[0])
    se = math.sqrt(4.8 / (n * h) * (1 / est[1] + 1 / est[0]))
    return {"left": est[0], "right": est[1], "log_difference": theta, "std_error": se, "p_value": dist.two_sided(theta / se)}


def bunching(df: DataFrame, x: str, threshold: float, width: float, bins: int = 50, order: int = 5, excluded: tuple[int, int] = (-2, 2)) -> dict[str, float]:
    """Excess mass at a kink: bin counts against a polynomial fitted without the excluded bins."""
    d = usable(df, {"x": num(x) - threshold})
    rows = d.where((F.col("x") >= -bins * width) & (F.col("x") < bins * width)).groupBy(F.floor(F.col("x") / width).alias("b")).agg(F.count("*").alias("n")).collect()
    count = {r.b: r.n for r in rows}
    b = np.arange(-bins, bins)
    c = np.array([float(count.get(int(i), 0)) for i in b])
    out = (b < excluded[0]) | (b > excluded[1])
    X = np.vander(b / bins, order + 1)
    fit = X @ np.linalg.lstsq(X[out], c[out], rcond=None)[0]
    excess = float((c - fit)[~out].sum())
    return {"excess": excess, "counterfactual": float(fit[~out].mean()), "b": excess / float(fit[~out].mean())}


def local_randomisation(df: DataFrame, y: str, running: str, cutoff: float, window: float) -> dict[str, float]:
    """Difference of means within a window, as if assigned at random."""
    d = usable(df, {"y": F.col(y), "x": num(running) - cutoff}).where(F.abs("x") <= window)
    r = {x.s: x for x in d.groupBy((F.col("x") >= 0).cast("int").alias("s")).agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"), F.count("*").alias("n")).collect()}
    se = math.sqrt(r[1].v / r[1].n + r[0].v / r[0].n)
    return {"estimate": r[1].m - r[0].m, "std_error": se, "p_value": dist.two_sided((r[1].m - r[0].m) / se)}


def checks(df: DataFrame, y: str, running: str, cutoff: float = 0.0, covariates: list[str] = [], placebos: list[float] = [], factors: list[float] = [0.5, 1.0, 2.0], donut: float = 0.0) -> DataFrame:
    """(check, at, estimate, std_error, p_value): covariate balance, placebo cutoffs on one side each, other bandwidths, a donut hole."""
    h = rule_of_thumb(usable(df, {"y": F.col(y), "x": num(running) - cutoff}))
    x = num(running)
    cases = [("balance", c, df, c, cutoff, h) for c in covariates]
    cases += [("placebo", str(p), df.where(x < cutoff if p < cutoff else x >= cutoff), y, p, h) for p in placebos]
    cases += [("bandwidth", str(f), df, y, cutoff, f * h) for f in factors]
    if donut:
        cases.append(("donut", str(donut), df.where(F.abs(x - cutoff) >= donut), y, cutoff, h))
    rows = []
    for kind, at, d, value, c, width in cases:
        r = rd(d, value, running, c, width)
        rows.append((kind, at, r["estimate"], r["std_error"], r["p_value"]))
    return df.sparkSession.createDataFrame(rows, "check string, at string, estimate double, std_error double, p_value double")


def multi_cutoff(df: DataFrame, y: str, running: str, cutoff: str, bandwidth: float | None = None) -> DataFrame:
    """(cutoff, estimate, std_error, n) at each cutoff of the column, and pooled by rows near it; cutoffs are few.

    A cutoff without enough rows on both sides has nulls and n 0, and no weight.
    """
    cuts = sorted(float(r[0]) for r in df.select(num(cutoff)).dropna().distinct().collect())
    rows = []
    for c in cuts:
        try:
            r = rd(df.where(num(cutoff) == c), y, running, c, bandwidth)
            rows.append((str(c), r["estimate"], r["std_error"], r["n_left"] + r["n_right"]))
        except DataInsufficient:
            rows.append((str(c), None, None, 0.0))
    met = [r for r in rows if r[3]]
    n = sum(r[3] for r in met)
    if not n:
        raise DataInsufficient("no cutoff has rows on both sides")
    rows.append(("pooled", sum(r[1] * r[3] for r in met) / n, math.sqrt(sum((r[2] * r[3]) ** 2 for r in met)) / n, n))
    return df.sparkSession.createDataFrame(rows, "cutoff string, estimate double, std_error double, n double")
