"""Distribution regression: a logit of ``y <= cut`` for every cut, all fitted together, and the quantile gaps built from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.operators.core import DataInsufficient, names_of, quantiles, usable

#: Cuts of one model at most: a Newton step brings one row per group and cut to the driver.
MOST_CUTS = 500


def cuts_of(df: DataFrame, y: str, n: int = 40) -> list[float]:
    """``n`` exact quantiles of ``y`` from the 2nd to the 98th in equal steps, repeated values once."""
    if not 1 < n <= MOST_CUTS:
        raise ValueError(f"from 2 to {MOST_CUTS} cuts")
    found = quantiles(df, [y], np.linspace(0.02, 0.98, n).tolist()).first()[0]
    if found is None:
        raise DataInsufficient("no usable rows")
    return sorted(set(found))


def _looked_up(table: np.ndarray, at: Column) -> list[Column]:
    """The coefficients of row ``at`` (from 0) of a small table, as expressions."""
    return [F.element_at(F.array(*[F.lit(v) for v in table[:, i].tolist()]), at + 1) for i in range(table.shape[1])]


def _chance(beta: list[Column], z: list[Column]) -> Column:
    return 1 / (1 + F.exp(-sum((b * v for b, v in zip(beta, z)), F.lit(0.0))))


def distribution_regression(df: DataFrame, y: str, x: list[str], cuts: list[float], group: str | None = None, tol: float = 1e-13, most: int = 60) -> dict:
    """{group: array of a row (constant, slopes) per cut}: logit models of ``y <= cut``.

    Every Newton step is one aggregation by group and cut, combined on the map side; a model leaves the sums once its
    decrement is below ``tol`` a row.  A cut with at most two rows on one side takes the constant share, kept from 0 and 1
    by a thousandth.  Where a covariate separates the sides the probabilities still settle, and the coefficients are those
    at which they did.  Rows with a null or NaN drop; without usable rows, or where a step cannot be solved, it raises.
    """
    if len(cuts) > MOST_CUTS:
        raise ValueError(f"at most {MOST_CUTS} cuts")
    d = usable(df, names_of([y, *x]), (group,) if group else ())
    d = d.select((F.col(group) if group else F.lit(0)).alias("__g"), F.col(y).alias("__y"), *[F.col(c).alias(f"__x{i}") for i, c in enumerate(x)])
    stats = d.agg(*[F.avg(f"__x{i}") for i in range(len(x))], *[F.stddev_pop(f"__x{i}") for i in range(len(x))], F.count("*")).first()
    if not stats[-1]:
        raise DataInsufficient("no usable rows")
    k, m = len(x) + 1, len(cuts)
    mid, sd = np.array(stats[: k - 1], dtype=float), np.array([s or 1.0 for s in stats[k - 1 : 2 * k - 2]], dtype=float)
    below = d.groupBy("__g").agg(F.count("*"), *[F.sum((F.col("__y") <= c).cast("long")) for c in cuts]).collect()
    groups = sorted(r[0] for r in below)
    size = {r[0]: r[1] for r in below}
    beta, open_ = {g: np.zeros((m, k)) for g in groups}, {g: [] for g in groups}
    for r in below:
        for j, s in enumerate(r[2:]):
            p = s / r[1]
            if s <= 2 or s >= r[1] - 2:
                p = min(max(p, 1e-3), 1 - 1e-3)
            else:
                open_[r[0]].append(j)
            beta[r[0]][j, 0] = np.log(p / (1 - p))
    z = [F.lit(1.0), *[(F.col(f"__x{i}") - F.lit(float(a))) / F.lit(float(s)) for i, (a, s) in enumerate(zip(mid, sd))]]
    d = d.select("__g", "__y", *[v.alias(f"__z{i}") for i, v in enumerate(z)])
    z = [F.col(f"__z{i}") for i in range(k)]
    number = lambda of: F.coalesce(*[F.when(F.col("__g") == F.lit(g), F.lit(i)) for i, g in enumerate(of)])
    for _ in range(most):
        live = [g for g in groups if open_[g]]
        if not live:
            break
        here = d.withColumn("__i", number(live)).where("__i is not null")
        todo = F.element_at(F.array(*[F.array(*[F.lit(j) for j in open_[g]]) for g in live]), F.col("__i") + 1)
        long = here.select("*", F.explode(todo).alias("__j")).withColumn("__p", _chance(_looked_up(np.vstack([beta[g] for g in live]), F.col("__i") * m + F.col("__j")), z))
        gap = (F.col("__y") <= F.element_at(F.array(*[F.lit(float(c)) for c in cuts]), F.col("__j") + 1)).cast("double") - F.col("__p")
        spread = F.col("__p") * (1 - F.col("__p"))
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        sums = long.groupBy("__i", "__j").agg(*[F.sum(gap * v).alias(f"s{a}") for a, v in enumerate(z)], *[F.sum(spread * z[a] * z[b]).alias(f"i{a}_{b}") for a, b in pairs])
        for r in sums.collect():
            g, j, score, info = live[r[0]], r[1], np.array(r[2 : 2 + k]), np.zeros((k, k))
            for (a, b), v in zip(pairs, r[2 + k :]):
                info[a, b] = info[b, a] = v
            step = np.linalg.pinv(info, rcond=1e-14) @ score
            if not np.isfinite(step).all():
                raise DataInsufficient(f"the model at {cuts[j]} of group {g} cannot be solved")
            beta[g][j] += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
            if step @ score < tol * size[g]:
                open_[g].remove(j)
    else:
        raise DataInsufficient("the models of some cuts do not converge")
    return {g: np.column_stack([b[:, 0] - (b[:, 1:] * mid / sd).sum(axis=1), b[:, 1:] / sd]) for g, b in beta.items()}


def counterfactual(df: DataFrame, y: str, x: list[str], group: str, cuts: list[float] | None = None, reference: int = 0, n_cuts: int = 40) -> tuple[list[float], np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, F of group 0, F of group 1, F with the reference's coefficients over the other group's covariates) at each cut.

    ``group`` is 0 or 1.  Each distribution is the mean of the fitted probabilities, made to rise by its running maximum.
    """
    d = usable(df, names_of([y, *x, group]))
    cuts = cuts_of(d, y, n_cuts) if cuts is None else sorted(set(map(float, cuts)))
    if reference not in (0, 1):
        raise ValueError("the reference is group 0 or 1")
    models = distribution_regression(d, y, x, cuts, group)
    if set(models) != {0.0, 1.0}:
        raise DataInsufficient("the groups are 0 and 1, both with rows")
    m, z = len(cuts), [F.lit(1.0), *[F.col(c) for c in x]]
    long = d.select(F.col(group).cast("int").alias("__g"), *x, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("__j"))
    table = np.vstack([models[0.0], models[1.0]])
    own, given = (_chance(_looked_up(table, at * m + F.col("__j")), z) for at in (F.col("__g"), F.lit(reference)))
    out = np.zeros((2, 2, m))
    for r in long.groupBy("__g", "__j").agg(F.avg(own), F.avg(given)).collect():
        out[:, r[0], r[1]] = r[2:]
    rising = lambda f: np.clip(np.maximum.accumulate(f), 0.0, 1.0)
    return cuts, rising(out[0, 0]), rising(out[0, 1]), rising(out[1, 1 - reference])


def cfm(df: DataFrame, y: str, x: list[str], group: str, taus: list[float] = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], reference: int = 0, n_cuts: int = 40, cuts: list[float] | None = None) -> DataFrame:
    """Gap of quantiles between group 0 and group 1, and its parts by covariates (composition) and coefficients (structure).

    A row per tau; quantiles are read off the distributions by straight lines between cuts and end at the outer cuts.
    """
    at, f0, f1, fc = counterfactual(df, y, x, group, cuts, reference, n_cuts)
    inverted = lambda f: np.interp(taus, f + 1e-9 * np.arange(len(f)), at)  # noqa: E731  a flat piece gets the least slope
    q0, q1, qc = inverted(f0), inverted(f1), inverted(fc)
    composition = q0 - qc if reference == 0 else qc - q1
    rows = zip(map(float, taus), *(v.tolist() for v in (q0, q1, qc, q0 - q1, composition, q0 - q1 - composition)))
    return df.sparkSession.createDataFrame(list(rows), "tau double, q_0 double, q_1 double, q_counterfactual double, gap double, composition double, structure double")
