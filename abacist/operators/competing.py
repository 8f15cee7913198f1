"""Competing risks: the regression of the subdistribution hazard.

A row that had another event stays at risk of the cause of interest, with a weight that falls as censoring
would have taken it.  Its weight at t is G(t-) / G(its own time-), so the sum over such rows is G(t-) times a
running sum over earlier times: a step needs one running sum from the end, over rows still there, and one from
the beginning, over rows that left for another cause.  Both run in cells over distinct times.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.operators.core import DataInsufficient, Fit, in_cells, inverse, names_of, running, usable
from abacist.operators.panel import written


def censoring(d: DataFrame) -> DataFrame:
    """(t, __cell, g): the share not yet censored just before each distinct time."""
    per = d.groupBy("t", "__cell").agg(F.count("*").cast("double").alias("n"), F.sum((F.col("e") == 0).cast("double")).alias("c"))
    risk = running(per, "t", {"n": F.col("n")}, down=True)
    # where the last rows are all censored nothing comes after
    step = F.when(F.col("c") < F.col("run_n"), F.log(1 - F.col("c") / F.col("run_n"))).otherwise(0.0)
    return running(risk.select("t", "__cell", step.alias("step")), "t", {"step": F.col("step")}).select("t", "__cell", F.exp(F.col("run_step") - F.col("step")).alias("g"))


def finegray(df: DataFrame, time: str, event: str, x: list, *, cause: int = 1, tol: float = 1e-10, most: int = 50) -> Fit:
    """Subdistribution hazards of ``cause`` in ``x``: ``event`` is 0 for censored rows, else the cause; rows with a null drop.

    Rows that leave at a time are at risk in it; tied events share its risk set.  Errors are those of the information.
    Raises without an event of the cause, or if the steps do not converge.
    """
    xs = names_of(x)
    names, k = list(xs), len(xs)
    d = usable(df, {"t": F.col(time), "e": F.col(event), **{f"x{i}": c for i, c in enumerate(xs.values())}})
    d = written(in_cells(d, "t"), df.sparkSession)
    means = d.agg(F.sum((F.col("e") == cause).cast("int")), F.count("*"), *[F.avg(f"x{i}") for i in range(k)]).first()
    if not means[0]:
        raise DataInsufficient("no event of the cause")
    d = d.withColumns({f"x{i}": F.col(f"x{i}") - F.lit(float(means[2 + i])) for i in range(k)})
    X, pairs = [F.col(f"x{i}") for i in range(k)], [(i, j) for i in range(k) for j in range(i, k)]
    g = written(censoring(d), df.sparkSession).select(F.col("t").alias("__t"), F.col("g"))
    own = np.array(d.where(F.col("e") == cause).agg(*[F.sum(c) for c in X]).first(), dtype=float)
    gone = (F.col("e") > 0) & (F.col("e") != cause)
    beta, last = np.zeros(k), None
    for _ in range(most):
        r = F.exp(sum((F.lit(float(b)) * c for b, c in zip(beta, X)), F.lit(0.0)))
        parts = {"s0": r, **{f"s1_{i}": r * X[i] for i in range(k)}, **{f"s2_{i}_{j}": r * X[i] * X[j] for i, j in pairs}}
        per = d.groupBy("t", "__cell").agg(F.sum((F.col("e") == cause).cast("double")).alias("m"), *[F.sum(v).alias(a) for a, v in parts.items()], *[F.sum(F.when(gone, v).otherwise(0.0)).alias(f"o_{a}") for a, v in parts.items()])
        per = written(per.join(g, F.col("t") == F.col("__t")).drop("__t").withColumns({f"o_{a}": F.col(f"o_{a}") / F.col("g") for a in parts}), df.sparkSession)
        there = running(per.select("t", "__cell", "m", "g", *parts), "t", {a: F.col(a) for a in parts}, down=True)
        left = running(per.select("t", "__cell", *[f"o_{a}" for a in parts]), "t", {a: F.col(f"o_{a}") for a in parts})
        left = left.select(F.col("t").alias("__t"), *[(F.col(f"run_{a}") - F.col(f"o_{a}")).alias(f"b_{a}") for a in parts])
        t = there.where("m > 0").join(left, F.col("t") == F.col("__t"))
        s = {a: F.col(f"run_{a}") + F.col("g") * F.col(f"b_{a}") for a in parts}
        m = F.col("m")
        row = t.agg(F.sum(-m * F.log(s["s0"])), *[F.sum(-m * s[f"s1_{i}"] / s["s0"]) for i in range(k)], *[F.sum(m * (s[f"s2_{i}_{j}"] / s["s0"] - s[f"s1_{i}"] * s[f"s1_{j}"] / (s["s0"] * s["s0"]))) for i, j in pairs]).first()
        ll, u, info = row[0] + float(beta @ own), np.array(row[1 : k + 1]) + own, np.zeros((k, k))
        for (i, j), v in zip(pairs, row[k + 1 :]):
            info[i, j] = info[j, i] = v
        bread = inverse(info)
        if last is not None and abs(ll - last) < tol * (abs(last) + 0.1):
            return Fit(names, beta, bread, means[1], math.inf, {"loglik": ll, "events": means[0]})
        beta, last = beta + bread @ u, ll
    raise DataInsufficient(f"the subdistribution model did not converge in {most} steps")
