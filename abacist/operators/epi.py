"""Epidemiology and diagnostics: measures of association, standardisation, agreement, ROC."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import num
from abacist.operators.core import running


def cells(df: DataFrame, exposure: str, outcome: str, by: list[str] = []) -> DataFrame:
    """a, b, c, d of the two-by-two table per stratum."""
    d = df.select(*by, num(exposure).alias("e"), num(outcome).alias("o")).dropna(subset=["e", "o"])
    n = lambda e, o: F.count(F.when((F.col("e") == e) & (F.col("o") == o), 1)).cast("double")
    return d.groupBy(*by).agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))


def measures(table: DataFrame, alpha: float = 0.05, by: list[str] = []) -> DataFrame:
    """Risk ratio, odds ratio, risk difference, attributable fraction and number needed, with intervals.

    A table with an empty cell takes 0.5 in each cell for the ratios.
    """
    z = dist.norm_ppf(1 - alpha / 2)
    zero = (F.col("a") == 0) | (F.col("b") == 0) | (F.col("c") == 0) | (F.col("d") == 0)
    t = table.withColumns({f"{c}_": F.col(c) + F.when(zero, 0.5).otherwise(0.0) for c in "abcd"})
    a, b, c, d = (F.col(f"{x}_") for x in "abcd")
    rr, odds = (a / (a + b)) / (c / (c + d)), a * d / (b * c)
    se_rr, se_or = F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    p1, p0 = F.col("a") / (F.col("a") + F.col("b")), F.col("c") / (F.col("c") + F.col("d"))
    se_rd = F.sqrt(p1 * (1 - p1) / (F.col("a") + F.col("b")) + p0 * (1 - p0) / (F.col("c") + F.col("d")))
    return t.select(
        *by, "a", "b", "c", "d", rr.alias("risk_ratio"), F.exp(F.log(rr) - z * se_rr).alias("rr_low"), F.exp(F.log(rr) + z * se_rr).alias("rr_high"),
        odds.alias("odds_ratio"), F.exp(F.log(odds) - z * se_or).alias("or_low"), F.exp(F.log(odds) + z * se_or).alias("or_high"),
        (p1 - p0).alias("risk_difference"), (p1 - p0 - z * se_rd).alias("rd_low"), (p1 - p0 + z * se_rd).alias("rd_high"), ((rr - 1) / rr).alias("attributable_fraction"), F.when(p1 != p0, 1 / F.abs(p1 - p0)).alias("number_needed"),
    )


def mantel_haenszel(df: DataFrame, exposure: str, outcome: str, strata: list[str], alpha: float = 0.05) -> dict[str, float]:
    """Pooled odds and risk ratios (Robins-Breslow-Greenland variance) and the continuity-corrected test."""
    t = cells(df, exposure, outcome, strata).withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d")).where("n > 0")
    a, b, c, d, n = (F.col(x) for x in ("a", "b", "c", "d", "n"))
    R, S, P, Q = a * d / n, b * c / n, (a + d) / n, (b + c) / n
    m1, e1 = a + c, (a + b) * (a + c) / n
    v = F.when(n > 1, (a + b) * (c + d) * m1 * (b + d) / (n * n * (n - 1))).otherwise(0.0)
    r = t.agg(F.sum(R), F.sum(S), F.sum(P * R), F.sum(P * S + Q * R), F.sum(Q * S), F.sum(a), F.sum(e1), F.sum(v), F.sum(a * (c + d) / n), F.sum(c * (a + b) / n)).first()
    odds = r[0] / r[1]
    se = math.sqrt(r[2] / (2 * r[0] ** 2) + r[3] / (2 * r[0] * r[1]) + r[4] / (2 * r[1] ** 2))
    z = dist.norm_ppf(1 - alpha / 2)
    chi = max(abs(r[5] - r[6]) - 0.5, 0) ** 2 / r[7]
    return {"odds_ratio": odds, "or_low": odds * math.exp(-z * se), "or_high": odds * math.exp(z * se), "risk_ratio": r[8] / r[9], "chi2": chi, "p_value": dist.chi2_sf(chi, 1)}


def direct_standardise(df: DataFrame, events: str, population: str, stratum: str, standard: str) -> DataFrame:
    """Crude and standardised rate with its variance; the standard population is a column of the strata."""
    d = df.groupBy(stratum).agg(F.sum(num(events)).alias("e"), F.sum(num(population)).alias("p"), F.first(num(standard)).alias("s"))
    w = F.col("s") / F.sum("s").over(Window.partitionBy())  # one row per stratum
    d = d.withColumn("w", w)
    return d.agg((F.sum("e") / F.sum("p")).alias("crude"), F.sum(F.col("w") * F.col("e") / F.col("p")).alias("rate"), F.sum(F.col("w") ** 2 * F.col("e") / F.col("p") ** 2).alias("variance"))


def indirect_standardise(df: DataFrame, events: str, population: str, stratum: str, reference_rate: str) -> DataFrame:
    """Observed, expected and their ratio (SMR) under reference rates."""
    d = df.groupBy(stratum).agg(F.sum(num(events)).alias("e"), F.sum(num(population)).alias("p"), F.first(num(reference_rate)).alias("r"))
    return d.agg(F.sum("e").alias("observed"), F.sum(F.col("p") * F.col("r")).alias("expected"), (F.sum("e") / F.sum(F.col("p") * F.col("r"))).alias("smr"))


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC points, one per distinct score; ties are one step."""
    t = running(_scores(df, score, label), "s", {"p": F.col("p"), "n": F.col("n")}, down=True)
    return t.select(F.col("s").alias("threshold"), (F.col("run_p") / F.col("all_p")).alias("tpr"), (F.col("run_n") / F.col("all_n")).alias("fpr"))


def _scores(df: DataFrame, score: str, label: str) -> DataFrame:
    d = df.select(num(score).alias("s"), num(label).alias("l")).dropna()
    return d.groupBy("s").agg(F.sum("l").alias("p"), F.sum(1 - F.col("l")).alias("n"))


def auc(df: DataFrame, score: str, label: str) -> dict[str, float]:
    """Area under the curve (ties count half) with Hanley and McNeil's standard error."""
    t = running(_scores(df, score, label), "s", {"n": F.col("n")})
    r = t.withColumn("under", F.col("run_n") - F.col("n")).agg(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)), F.sum("p"), F.sum("n")).first()
    a, p, n = r[0] / (r[1] * r[2]), r[1], r[2]
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    return {"auc": a, "std_error": math.sqrt((a * (1 - a) + (p - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a)) / (p * n)), "positives": p, "negatives": n}


def diagnostic(table: DataFrame) -> DataFrame:
    """Sensitivity, specificity, predictive values, likelihood ratios, accuracy and Youden's index; rows are test, columns truth."""
    a, b, c, d = (F.col(x) for x in "abcd")
    sens, spec = a / (a + c), d / (b + d)
    return table.select(sens.alias("sensitivity"), spec.alias("specificity"), (a / (a + b)).alias("ppv"), (d / (c + d)).alias("npv"), (sens / (1 - spec)).alias("lr_plus"), ((1 - sens) / spec).alias("lr_minus"), ((a + d) / (a + b + c + d)).alias("accuracy"), (sens + spec - 1).alias("youden"))


def kappa(df: DataFrame, first: str, second: str) -> tuple[float, float]:
    """(Cohen's kappa, observed agreement) of two raters."""
    d = df.select(F.col(first).cast("string").alias("x"), F.col(second).cast("string").alias("y")).dropna()
    t = d.groupBy("x", "y").count()
    n, same = t.agg(F.sum("count"), F.sum(F.when(F.col("x") == F.col("y"), F.col("count")).otherwise(0))).first()
    x, y = t.groupBy("x").agg(F.sum("count").alias("a")), t.groupBy("y").agg(F.sum("count").alias("b"))
    chance = (x.join(y, F.col("x") == F.col("y")).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0) / n / n
    return (same / n - chance) / (1 - chance), same / n


def bland_altman(df: DataFrame, first: str, second: str) -> DataFrame:
    d = df.select((num(first) - num(second)).alias("d")).dropna()
    return d.agg(F.avg("d").alias("bias"), F.stddev("d").alias("sd")).selectExpr("bias", "sd", "bias - 1.959963984540054 * sd as low", "bias + 1.959963984540054 * sd as high")


def e_value(rr: float, low: float | None = None, high: float | None = None) -> dict[str, float]:
    """How strong unmeasured confounding must be to explain a risk ratio away."""
    f = lambda r: r + math.sqrt(r * (r - 1)) if r >= 1 else f(1 / r)
    bound = None if low is None else (1.0 if low <= 1 <= high else f(low if rr >= 1 else high))
    return {"e_value": f(rr), "e_value_ci": bound}


def bradford_rate_ratio(df: DataFrame, exposure: str, events: str, person_time: str, alpha: float = 0.05) -> DataFrame:
    """Incidence rates by exposure, their ratio and difference."""
    d = df.select(num(exposure).alias("x"), num(events).alias("e"), num(person_time).alias("t")).dropna()
    s = lambda c, v: F.sum(F.when(F.col("x") == v, F.col(c)))
    z = dist.norm_ppf(1 - alpha / 2)
    r = d.agg(s("e", 1).alias("e1"), s("t", 1).alias("t1"), s("e", 0).alias("e0"), s("t", 0).alias("t0"))
    ratio, se = (F.col("e1") / F.col("t1")) / (F.col("e0") / F.col("t0")), F.sqrt(1 / F.col("e1") + 1 / F.col("e0"))
    return r.select((F.col("e1") / F.col("t1")).alias("rate1"), (F.col("e0") / F.col("t0")).alias("rate0"), ratio.alias("ratio"), (ratio * F.exp(-z * se)).alias("ratio_low"), (ratio * F.exp(z * se)).alias("ratio_high"), (F.col("e1") / F.col("t1") - F.col("e0") / F.col("t0")).alias("difference"))


def attributable(table: DataFrame) -> DataFrame:
    """Attributable fractions (of the exposed, of the population) and the number needed to harm, per row of a table a, b, c, d."""
    a, b, c, d = (F.col(x) for x in "abcd")
    r1, r0, r = a / (a + b), c / (c + d), (a + c) / (a + b + c + d)
    return table.withColumns({"attributable_exposed": (r1 - r0) / r1, "attributable_population": (r - r0) / r, "number_needed": F.when(r1 != r0, 1 / F.abs(r1 - r0))})


def breslow_day(df: DataFrame, exposure: str, outcome: str, strata: list[str]) -> tuple[float, int, float]:
    """(chi-square, df, p) of equal odds ratios over strata."""
    t = cells(df, exposure, outcome, strata).where("a + b > 0 and c + d > 0 and a + c > 0 and b + d > 0")
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    num_, den = t.agg(F.sum(F.col("a") * F.col("d") / n), F.sum(F.col("b") * F.col("c") / n)).first()
    psi = num_ / den
    m1, n1 = (F.col("a") + F.col("c")).cast("double"), (F.col("a") + F.col("b")).cast("double")
    # expected a solves psi = a (n - m1 - n1 + a) / ((m1 - a) (n1 - a))
    if abs(psi - 1) < 1e-12:
        e = m1 * n1 / n
    else:
        q = psi * (m1 + n1) + (n - m1 - n1)
        e = (q - F.sqrt(q * q - 4 * psi * (psi - 1) * m1 * n1)) / (2 * (psi - 1))
    v = 1 / (1 / e + 1 / (m1 - e) + 1 / (n1 - e) + 1 / (n - m1 - n1 + e))
    stat, k = t.agg(F.sum((F.col("a") - e) ** 2 / v), F.count("*")).first()
    return stat, k - 1, dist.chi2_sf(stat, k - 1)


def fisher_exact(a: int, b: int, c: int, d: int) -> dict[str, float]:
    """Two-sided exact test of a 2 x 2 table: tables no more likely than this one, under fixed margins."""
    n, r, k = a + b + c + d, a + b, a + c
    choose = lambda m, i: math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1)
    log = lambda i: choose(r, i) + choose(n - r, k - i) - choose(n, k)
    own, least, most = log(a), max(0, k - (n - r)), min(r, k)
    mode = min(max((r + 1) * (k + 1) // (n + 2), least), most)
    p = 0.0
    # outwards from the likeliest table; what is left out weighs under 1e-18
    for way in (range(mode, most + 1), range(mode - 1, least - 1, -1)):
        for i in way:
            v = log(i)
            if v < -45 and v < own - 1e-7:
                break
            if v <= own + 1e-7:
                p += math.exp(v)
    return {"odds_ratio": a * d / (b * c) if b * c else math.inf, "p_value": min(1.0, p)}
