"""Design-based estimates from PSU totals, and calibration of weights."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import num


def _linearised(d: DataFrame, score, strata: str, psu: str, fpc: str | None) -> tuple[float, int]:
    """(variance, design degrees of freedom): between-PSU variance of score totals per stratum; lone PSUs are skipped."""
    totals = d.groupBy(strata, psu).agg(F.sum(score).alias("z"), *([F.first(fpc).alias("f")] if fpc else []))
    per = totals.groupBy(strata).agg(F.count("*").alias("n"), F.var_samp("z").alias("v"), *([F.first("f").alias("f")] if fpc else []))
    scale = F.lit(1.0) - (F.col("n") / F.col("f") if fpc else F.lit(0.0))
    r = per.where("n > 1").agg(F.sum(scale * F.col("n") * F.col("v")), F.sum(F.col("n") - 1)).first()
    return r[0] or 0.0, r[1] or 0


def svy(df: DataFrame, y: str, weight: str, strata: str, psu: str, kind: str = "mean", fpc: str | None = None, alpha: float = 0.05) -> dict[str, float]:
    """Mean or total with its linearised standard error and t interval."""
    d = df.select(num(y).alias("y"), num(weight).alias("w"), strata, psu, *([fpc] if fpc else [])).dropna()
    w, wy = d.agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
    est = wy / w if kind == "mean" else wy
    score = F.col("w") * (F.col("y") - est) / w if kind == "mean" else F.col("w") * F.col("y")
    v, free = _linearised(d, score, strata, psu, fpc)
    se, q = math.sqrt(v), dist.t_ppf(1 - alpha / 2, free) if free else math.nan
    return {"estimate": est, "std_error": se, "ci_low": est - q * se, "ci_high": est + q * se, "df": float(free)}


def svy_ratio(df: DataFrame, y: str, x: str, weight: str, strata: str, psu: str) -> dict[str, float]:
    d = df.select(num(y).alias("y"), num(x).alias("x"), num(weight).alias("w"), strata, psu).dropna()
    wy, wx = d.agg(F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * F.col("x"))).first()
    v, free = _linearised(d, F.col("w") * (F.col("y") - wy / wx * F.col("x")) / wx, strata, psu, None)
    return {"estimate": wy / wx, "std_error": math.sqrt(v), "df": float(free)}


def design_effect(df: DataFrame, weight: str) -> float:
    """Kish's approximate design effect of the weights."""
    n, s, q = df.select(num(weight).alias("w")).dropna().agg(F.count("*"), F.sum("w"), F.sum(F.col("w") ** 2)).first()
    return n * q / s**2


def rake(df: DataFrame, margins: dict[str, dict], weight: str | None = None, tol: float = 1e-6, most: int = 100) -> DataFrame:
    """Weights (column ``raked``, summing to 1) whose margins meet the targets, by iterative proportional fitting.

    The fitting runs on the table of distinct cells of the margin columns; rows are joined once.
    """
    cols = list(margins)
    base = num(weight) if weight else F.lit(1.0)
    d = df.withColumn("__w", base)
    grid = d.groupBy(*cols).agg(F.sum("__w").alias("__b")).collect()
    if len(grid) > 100_000:
        raise ValueError("too many distinct cells")
    total = sum(r["__b"] for r in grid)
    cell = {tuple(r[: len(cols)]): r["__b"] / total for r in grid}
    factor = dict.fromkeys(cell, 1.0)
    for _ in range(most):
        before = dict(factor)
        for i, c in enumerate(cols):
            goal = sum(margins[c].values())
            for level, target in margins[c].items():
                now = sum(cell[k] * factor[k] for k in cell if k[i] == level)
                if now > 0:
                    for k in cell:
                        if k[i] == level:
                            factor[k] *= target / goal / now
        s = sum(cell[k] * factor[k] for k in cell)
        factor = {k: v / s for k, v in factor.items()}
        if max(abs(factor[k] - before[k]) * cell[k] for k in cell) < tol:
            break
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)
    f = df.sparkSession.createDataFrame([(*k, v / total) for k, v in factor.items()], f"{kinds}, __f double")
    return d.join(F.broadcast(f), cols).withColumn("raked", F.col("__w") * F.col("__f")).drop("__w", "__f")


def post_stratify(df: DataFrame, stratum: str, targets: dict, weight: str) -> DataFrame:
    """Weights scaled so that each stratum has its target total."""
    kind = df.schema[stratum].dataType.simpleString()
    t = df.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], f"`{stratum}` {kind}, __t double")
    s = df.groupBy(stratum).agg(F.sum(num(weight)).alias("__s")).join(t, stratum)
    return df.join(F.broadcast(s) if len(targets) <= 10_000 else s, stratum).withColumn("post_weight", num(weight) * F.col("__t") / F.col("__s")).drop("__t", "__s")


def calibrate(df: DataFrame, totals: dict[str, float], weight: str) -> DataFrame:
    """Adds ``calibrated``: linear calibration of weights to known totals of columns (use a column of ones for the count)."""
    x = list(totals)
    w = num(weight)
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = df.agg(*[F.sum(w * num(c)) for c in x], *[F.sum(w * num(x[i]) * num(x[j])) for i, j in pairs]).first()
    m = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, row[len(x) :]):
        m[i, j] = m[j, i] = v
    lam = np.linalg.solve(m, np.array([totals[c] for c in x]) - np.array(row[: len(x)], dtype=float))
    return df.withColumn("calibrated", w * (1 + sum((F.lit(float(a)) * num(c) for a, c in zip(lam, x)), F.lit(0.0))))
