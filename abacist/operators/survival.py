"""Survival analysis on the table of distinct times, never on sorted rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import num
from abacist.operators.core import DataInsufficient, Fit, in_cells, inverse, meat, running, usable


def risk_table(df: DataFrame, time: str, event: str, by: list[str] = [], weight: str | None = None) -> DataFrame:
    """Per distinct time (and group): deaths, leavers and the number at risk; ``__cell`` is kept for further running sums."""
    w = num(weight) if weight else F.lit(1.0)
    d = df.select(*by, num(time).alias("time"), num(event).alias("__e"), w.alias("__w")).dropna(subset=["time", "__e", "__w"])
    ev = d.groupBy(*by, "time").agg(F.sum(F.col("__w") * F.col("__e")).alias("deaths"), F.sum("__w").alias("leave"))
    return running(in_cells(ev, "time"), "time", {"leave": F.col("leave")}, by, down=True).withColumnRenamed("run_leave", "at_risk").drop("all_leave")


def _curve(df: DataFrame, time: str, event: str, by: list[str]) -> DataFrame:
    """The risk table's event times with the curve at (``survival``) and just before (``before``) each, and Greenwood's sum."""
    left = F.col("at_risk") - F.col("deaths")
    t = risk_table(df, time, event, by).where("deaths > 0")
    # the product as a sum of logarithms; a time at which all die ends the curve at zero
    t = t.withColumns({"log": F.when(left > 0, F.log(left / F.col("at_risk"))).otherwise(0.0), "end": F.when(left > 0, 0).otherwise(1)})
    g = F.when(left > 0, F.col("deaths") / (F.col("at_risk") * left)).otherwise(0.0)
    t = running(t, "time", {"log": F.col("log"), "g": g, "end": F.col("end")}, by)
    ended = lambda n: F.when(n > 0, 0.0)
    return t.withColumns({"survival": ended(F.col("run_end")).otherwise(F.exp("run_log")), "before": ended(F.col("run_end") - F.col("end")).otherwise(F.exp(F.col("run_log") - F.col("log")))})


def kaplan_meier(df: DataFrame, time: str, event: str, by: list[str] = [], alpha: float = 0.05) -> DataFrame:
    """Survival at each event time with Greenwood's variance and a linear interval clipped to [0, 1]."""
    z = dist.norm_ppf(1 - alpha / 2)
    t = _curve(df, time, event, by).withColumn("std_error", F.col("survival") * F.sqrt("run_g"))
    lo, hi = F.col("survival") - z * F.col("std_error"), F.col("survival") + z * F.col("std_error")
    return t.select(*by, "time", "at_risk", "deaths", "survival", "std_error", F.greatest(lo, F.lit(0.0)).alias("ci_low"), F.least(hi, F.lit(1.0)).alias("ci_high"))


def nelson_aalen(df: DataFrame, time: str, event: str, by: list[str] = []) -> DataFrame:
    t = running(risk_table(df, time, event, by).where("deaths > 0"), "time", {"h": F.col("deaths") / F.col("at_risk")}, by)
    return t.select(*by, "time", "at_risk", "deaths", F.col("run_h").alias("hazard"))


def median_survival(df: DataFrame, time: str, event: str, by: list[str] = []) -> DataFrame:
    return kaplan_meier(df, time, event, by).where("survival <= 0.5").groupBy(*by).agg(F.min("time").alias("median"))


def rmst(df: DataFrame, time: str, event: str, tau: float, by: list[str] = []) -> DataFrame:
    """Restricted mean survival time: the area under the survival curve up to ``tau``."""
    t = _curve(df, time, event, by).where(F.col("time") < tau)
    fall = (F.lit(float(tau)) - F.col("time")) * F.col("before") * F.col("deaths") / F.col("at_risk")
    lost = t.groupBy(*by).agg(F.sum(fall).alias("lost"))
    if not by:
        return lost.select((F.lit(float(tau)) - F.coalesce("lost", F.lit(0.0))).alias("rmst"))
    lost = lost.select(*[F.col(b).alias(f"__{b}") for b in by], "lost")
    groups = df.select(*by).distinct()
    met = [groups[b].eqNullSafe(lost[f"__{b}"]) for b in by]
    return groups.join(lost, met, "left").select(*by, (F.lit(float(tau)) - F.coalesce("lost", F.lit(0.0))).alias("rmst"))


def logrank(df: DataFrame, time: str, event: str, group: str, weight: str = "logrank") -> tuple[float, int, float]:
    """(chi-square, df, p) of equal survival; ``gehan`` weights by the number at risk."""
    d = df.select(num(time).alias("time"), num(event).alias("e"), F.col(group).alias("g")).dropna()
    groups = sorted(r[0] for r in d.select("g").distinct().collect())
    per = d.groupBy("time").agg(*[F.sum(F.when(F.col("g") == F.lit(g), F.col("e")).otherwise(0.0)).alias(f"d{i}") for i, g in enumerate(groups)], *[F.count(F.when(F.col("g") == F.lit(g), 1)).alias(f"l{i}") for i, g in enumerate(groups)])
    k = len(groups)
    t = running(per, "time", {f"l{i}": F.col(f"l{i}") for i in range(k)}, down=True)
    t = t.withColumns({f"n{i}": F.col(f"run_l{i}").cast("double") for i in range(k)})
    dd, nn = sum((F.col(f"d{i}") for i in range(k)), F.lit(0.0)), sum((F.col(f"n{i}") for i in range(k)), F.lit(0.0))
    t = t.withColumns({"d": dd, "n": nn}).where("d > 0")
    w = F.lit(1.0) if weight == "logrank" else F.col("n")
    v = lambda i, j: w * w * F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0) * F.col(f"n{i}") / F.col("n") * (float(i == j) - F.col(f"n{j}") / F.col("n"))
    row = t.agg(*[F.sum(w * (F.col(f"d{i}") - F.col("d") * F.col(f"n{i}") / F.col("n"))) for i in range(k - 1)], *[F.sum(v(i, j)) for i in range(k - 1) for j in range(k - 1)]).first()
    u, m = np.array(row[: k - 1]), np.array(row[k - 1 :]).reshape(k - 1, k - 1)
    stat = float(u @ np.linalg.solve(m, u))
    return stat, k - 1, dist.chi2_sf(stat, k - 1)


def cox(df: DataFrame, time: str, event: str, x: list[str], ties: str = "efron", robust: bool = False, tol: float = 1e-9, most: int = 30) -> Fit:
    """Proportional hazards by Newton steps.

    Each step aggregates exp(xb) and its first two moments per distinct time; risk sets are then
    reverse running sums over the table of distinct times.
    """
    k = len(x)
    d = usable(df, {"t": F.col(time), "e": F.col(event), **{f"x{i}": F.col(c) for i, c in enumerate(x)}})
    means = d.agg(F.count("*"), *[F.avg(f"x{i}") for i in range(k)]).first()
    if not means[0]:
        raise DataInsufficient("no usable rows")
    d = d.withColumns({f"x{i}": F.col(f"x{i}") - F.lit(means[1 + i]) for i in range(k)})
    X = [F.col(f"x{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    beta, last = np.zeros(k), None
    d = in_cells(d, "t")

    def at_risk(per: DataFrame, parts) -> DataFrame:
        return running(per, "t", {a: F.col(a) for a in parts}, down=True).withColumns({a: F.col(f"run_{a}") for a in parts})

    for _ in range(most):
        r = F.exp(sum((F.lit(b) * c for b, c in zip(beta.tolist(), X)), F.lit(0.0)))
        parts = {"s0": r, **{f"s1_{i}": r * X[i] for i in range(k)}, **{f"s2_{i}_{j}": r * X[i] * X[j] for i, j in pairs}}
        per = d.groupBy("t", "__cell").agg(F.sum("e").alias("m"), *[F.sum(v).alias(a) for a, v in parts.items()], *[F.sum(F.col("e") * v).alias(f"d_{a}") for a, v in parts.items()], *[F.sum(F.col("e") * c).alias(f"xd{i}") for i, c in enumerate(X)])
        t = at_risk(per, parts).where("m > 0")
        steps = F.sequence(F.lit(0), F.col("m").cast("int") - 1)
        t = t.withColumn("f", F.explode(F.transform(steps, lambda s: s / F.col("m")))) if ties == "efron" else t.withColumn("f", F.lit(0.0))
        once = F.lit(1.0) if ties == "efron" else F.col("m")
        eff = {a: F.col(a) - F.col("f") * F.col(f"d_{a}") for a in parts}
        loglik = F.sum(-once * F.log(eff["s0"]))
        score = [F.sum(-once * eff[f"s1_{i}"] / eff["s0"]) for i in range(k)]
        info = [F.sum(once * (eff[f"s2_{i}_{j}"] / eff["s0"] - eff[f"s1_{i}"] * eff[f"s1_{j}"] / (eff["s0"] * eff["s0"]))) for i, j in pairs]
        own = d.where("e > 0").agg(*[F.sum(c) for c in X]).first()
        row = t.agg(loglik, *score, *info).first()
        ll = row[0] + float(np.dot(beta, own))
        u = np.array(row[1 : k + 1]) + np.array(own, dtype=float)
        m = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[k + 1 :]):
            m[i, j] = m[j, i] = v
        bread = inverse(m)
        if last is not None and abs(ll - last) < tol * (abs(last) + 0.1):
            break
        beta, last = beta + bread @ u, ll
    else:
        raise DataInsufficient(f"the risk-set model did not converge in {most} steps")
    v = bread
    if robust:
        # score residuals with running sums of the baseline hazard over distinct times
        base = at_risk(per, parts).select("t", "__cell", "m", *parts)
        hazard = F.col("m") / F.col("s0")
        base = running(base, "t", {"h": hazard, **{f"hb{i}": hazard * F.col(f"s1_{i}") / F.col("s0") for i in range(k)}})
        base = base.select("t", *[(F.col(f"s1_{i}") / F.col("s0")).alias(f"b{i}") for i in range(k)], F.col("run_h").alias("h"), *[F.col(f"run_hb{i}").alias(f"hb{i}") for i in range(k)])
        r = F.exp(sum((F.lit(b) * c for b, c in zip(beta.tolist(), X)), F.lit(0.0)))
        j = d.join(base, "t")
        scores = [F.col("e") * (X[i] - F.col(f"b{i}")) - r * (X[i] * F.col("h") - F.col(f"hb{i}")) for i in range(k)]
        mt, _ = meat(j, scores)
        v = bread @ mt @ bread
    return Fit(list(x), beta, v, means[0], math.inf, {"loglik": ll})


def cumulative_incidence(df: DataFrame, time: str, cause: str, by: list[str] = []) -> DataFrame:
    """Aalen and Johansen's incidence of each cause (0: censored) at its event times."""
    d = df.select(*by, num(time).alias("time"), F.col(cause).alias("cause")).dropna(subset=["time", "cause"])
    curve = _curve(d.withColumn("__e", (F.col("cause") != 0).cast("double")), "time", "__e", by)
    curve = curve.select(*[F.col(b).alias(f"__by_{b}") for b in by], F.col("time").alias("__time"), "__cell", (F.col("before") / F.col("at_risk")).alias("__step"))
    per = d.where("cause <> 0").groupBy(*by, "cause", "time").agg(F.count("*").alias("n"))
    met = [per[b].eqNullSafe(curve[f"__by_{b}"]) for b in by] + [per["time"] == curve["__time"]]
    steps = per.join(curve, met).select(*by, "cause", "time", "__cell", "n", (F.col("n") * F.col("__step")).alias("__rise"))
    return running(steps, "time", {"rise": F.col("__rise")}, [*by, "cause"]).select(*by, "cause", "time", "n", F.col("run_rise").alias("incidence"))


def life_table(df: DataFrame, time: str, event: str, width: float, by: list[str] = []) -> DataFrame:
    """Actuarial table by intervals of ``width``: entering, events, withdrawn, survival at the interval's end."""
    d = df.select(*by, num(time).alias("t"), num(event).alias("e")).dropna(subset=["t", "e"])
    per = d.groupBy(*by, (F.floor(F.col("t") / width) * float(width)).cast("double").alias("start")).agg(F.sum("e").alias("events"), F.sum(1 - F.col("e")).alias("withdrawn"))
    per = running(per, "start", {"n": F.col("events") + F.col("withdrawn")}, by, down=True).withColumnRenamed("run_n", "entering").drop("all_n")
    exposed = F.col("entering") - F.col("withdrawn") / 2
    left = 1 - F.col("events") / exposed
    t = running(per.withColumn("__left", left), "start", {"log": F.when(F.col("__left") > 0, F.log("__left")).otherwise(0.0), "end": F.when(F.col("__left") > 0, 0).otherwise(1)}, by)
    return t.select(*by, "start", "entering", "events", "withdrawn", F.when(F.col("run_end") > 0, 0.0).otherwise(F.exp("run_log")).alias("survival"))


def incidence_rates(df: DataFrame, time: str, event: str, by: list[str] = [], alpha: float = 0.05) -> DataFrame:
    """Events per time at risk with a log-normal interval."""
    z = dist.norm_ppf(1 - alpha / 2)
    r = df.select(*by, num(time).alias("t"), num(event).alias("e")).dropna(subset=["t", "e"]).groupBy(*by).agg(F.sum("e").alias("events"), F.sum("t").alias("person_time"))
    rate, f = F.col("events") / F.col("person_time"), F.exp(z / F.sqrt("events"))
    return r.withColumns({"rate": rate, "ci_low": F.when(F.col("events") > 0, rate / f), "ci_high": F.when(F.col("events") > 0, rate * f)})
