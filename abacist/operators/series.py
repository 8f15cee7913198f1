"""Time series, synthetic control, summary-data methods and power: small series after one aggregation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import num
from abacist.operators.core import DataInsufficient, Fit, running
from abacist.operators.regression import ols


def interrupted(df: DataFrame, y: str, time: str, intervention: float, lags: int = 4) -> Fit:
    """Segmented regression of period means: level, trend, change of level and of trend, with Newey-West errors."""
    s = df.groupBy(time).agg(F.avg(num(y)).alias("y"))
    s = s.withColumn("t", F.row_number().over(Window.orderBy(time)).cast("double"))  # one row per period
    start = s.where(F.col(time) >= F.lit(intervention)).agg(F.min("t")).first()[0]
    if start is None:
        raise DataInsufficient("no period after the intervention")
    post = (F.col("t") >= start).cast("double")
    return ols(s, "y", [("trend", F.col("t")), ("level", post), ("slope", post * (F.col("t") - start))], vcov="HAC", order="t", lags=lags)


def local_projection(df: DataFrame, y: str, shock: str, time: str, horizons: int = 8) -> DataFrame:
    """Impulse responses: regressions of led outcomes on the shock and one lag of each, with HAC errors."""
    w = Window.orderBy(time)  # a single series, one row per period
    base = df.groupBy(time).agg(F.avg(num(y)).alias("y"), F.avg(num(shock)).alias("s"))
    base = base.withColumns({"ly": F.lag("y").over(w), "ls": F.lag("s").over(w), **{f"y{h}": F.lead("y", h).over(w) for h in range(horizons + 1)}})
    lags, rows = max(1, round(1.5 * horizons)), []
    for h in range(horizons + 1):
        fit = ols(base, f"y{h}", ["s", "ly", "ls"], vcov="HAC", order=time, lags=max(h, lags))
        rows.append((h, fit["s"], fit.stderr("s"), dist.two_sided(fit["s"] / fit.stderr("s"))))
    return df.sparkSession.createDataFrame(rows, "horizon int, response double, std_error double, p_value double")


def autocorrelation(df: DataFrame, y: str, time: str, lags: int = 10) -> DataFrame:
    """(lag, acf) with the Ljung-Box statistic and its p-value up to each lag."""
    w = Window.orderBy(time)
    s = df.groupBy(time).agg(F.avg(num(y)).alias("y"))
    n, m, v = s.agg(F.count("*"), F.avg("y"), F.var_pop("y")).first()
    z = s.select(time, (F.col("y") - m).alias("z"))
    z = z.select("z", *[F.lag("z", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    r = [x / (n * v) for x in z.agg(*[F.sum(F.col("z") * F.col(f"l{k}")) for k in range(1, lags + 1)]).first()]
    q, rows = 0.0, []
    for k, x in enumerate(r, 1):
        q += n * (n + 2) * x * x / (n - k)
        rows.append((k, x, q, dist.chi2_sf(q, k)))
    return df.sparkSession.createDataFrame(rows, "lag int, acf double, ljung_box double, p_value double")


def granger(df: DataFrame, y: str, x: str, time: str, lags: int = 2) -> tuple[float, float]:
    """(F, p): do lags of x help to predict y beyond its own lags?"""
    w = Window.orderBy(time)
    s = df.groupBy(time).agg(F.avg(num(y)).alias("y"), F.avg(num(x)).alias("x"))
    s = s.withColumns({**{f"y{k}": F.lag("y", k).over(w) for k in range(1, lags + 1)}, **{f"x{k}": F.lag("x", k).over(w) for k in range(1, lags + 1)}}).dropna()
    own = [f"y{k}" for k in range(1, lags + 1)]
    a, b = ols(s, "y", own), ols(s, "y", [*own, *[f"x{k}" for k in range(1, lags + 1)]])
    free = b.n - len(b.names)
    f = (a.extra["rss"] - b.extra["rss"]) / lags / (b.extra["rss"] / free)
    return f, dist.f_sf(f, lags, free)


def simplex(target: np.ndarray, donors: np.ndarray, most: int = 20_000) -> np.ndarray:
    """Non-negative weights summing to 1 that fit donors (rows x donors) to the target: accelerated projected gradient."""
    n = donors.shape[1]
    w = v = np.full(n, 1 / n)
    a, b = donors.T @ donors, donors.T @ target
    step, t = 1 / (np.linalg.eigvalsh(a)[-1] + 1e-12), 1.0
    for _ in range(most):
        z = v - step * (a @ v - b)
        u = np.sort(z)[::-1]
        c = (np.cumsum(u) - 1) / np.arange(1, n + 1)
        new = np.maximum(z - c[np.flatnonzero(u > c)[-1]], 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-12:
            break
        w, t = new, t2
    return new


#: Units x periods of a panel that is brought to the driver for synthetic control.
MOST_CELLS = 2_000_000


def _wide(df: DataFrame, y: str, unit: str, time: str):
    c = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), num(y).alias("y")).dropna().groupBy("u", "t").agg(F.avg("y").alias("y")).limit(MOST_CELLS + 1).collect()
    if len(c) > MOST_CELLS:
        raise ValueError("too many cells: aggregate units or periods first")
    us, ts = sorted({r.u for r in c}), sorted({r.t for r in c})
    m = np.full((len(ts), len(us)), np.nan)
    ui, ti = {u: i for i, u in enumerate(us)}, {t: i for i, t in enumerate(ts)}
    for r in c:
        m[ti[r.t], ui[r.u]] = r.y
    return us, ts, m


def _gap(m: np.ndarray, pre: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit ``i`` less its weighted donors by period, the weights of the others)."""
    others = np.delete(m, i, axis=1)
    w = simplex(m[pre, i], others[pre])
    return m[:, i] - others @ w, w


def _ratio(gap: np.ndarray, pre: np.ndarray) -> float:
    return math.sqrt(np.mean(gap[~pre] ** 2) / max(np.mean(gap[pre] ** 2), 1e-300))


def _placebos(spark, m: np.ndarray, pre: np.ndarray) -> list[float]:
    """Every unit's ratio as if it were treated: units are dealt to tasks, the matrix (``MOST_CELLS`` at most) is broadcast."""
    held = spark.sparkContext.broadcast((m, pre))

    def solve(frames):
        for f in frames:
            f["ratio"] = [_ratio(_gap(held.value[0], held.value[1], int(i))[0], held.value[1]) for i in f["id"]]
            yield f

    parts = min(m.shape[1], 4 * spark.sparkContext.defaultParallelism)
    try:
        return [r[1] for r in sorted(spark.range(0, m.shape[1], 1, parts).mapInPandas(solve, "id long, ratio double").collect())]
    finally:
        held.unpersist()


def synthetic_control(df: DataFrame, y: str, unit: str, time: str, treated, start) -> dict:
    """Gap between a treated unit and the weighted donors, with placebo ranks of the ratio of post to pre fit.

    The balanced units x periods matrix is bounded; the placebo fits, one per unit, run as tasks.
    """
    us, ts, m = _wide(df, y, unit, time)
    keep = ~np.isnan(m).any(axis=0)
    us, m = [u for u, k in zip(us, keep) if k], m[:, keep]
    pre = np.array([t < start for t in ts])
    if treated not in us or len(us) < 2 or not pre.any() or pre.all():
        raise DataInsufficient("the treated unit and a donor need a value in every period, before and after the start")
    at = us.index(treated)
    g, w = _gap(m, pre, at)
    ratios = _placebos(df.sparkSession, m, pre)
    weights = dict(zip([u for u in us if u != treated], w.tolist()))
    return {"att": float(g[~pre].mean()), "weights": weights, "gaps": dict(zip(ts, g.tolist())), "p_value": sum(r >= ratios[at] for r in ratios) / len(ratios), "pre_rmse": float(math.sqrt(np.mean(g[pre] ** 2)))}


# ---------------------------------------------------------------- summary-data (Mendelian randomisation)
def mr(df: DataFrame, bx: str, by: str, se_y: str) -> dict[str, float]:
    """Inverse-variance weighted, Egger and weighted-median estimates from variant effects; Cochran's Q."""
    d = df.select(num(bx).alias("x"), num(by).alias("y"), num(se_y).alias("s")).dropna().where("x <> 0 and s > 0")
    w = 1 / F.col("s") ** 2
    x, y = F.abs("x"), F.signum("x") * F.col("y")
    r = d.agg(F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * x * y), F.sum(w * y * y), F.count("*")).first()
    ivw = r[4] / r[3]
    q = r[5] - ivw * r[4]
    det = r[0] * r[3] - r[1] ** 2
    slope, inter = (r[0] * r[4] - r[1] * r[2]) / det, (r[3] * r[2] - r[1] * r[4]) / det
    rss = r[5] - inter * r[2] - slope * r[4]
    s2 = max(rss / (r[6] - 2), 1.0) if r[6] > 2 else math.nan
    v = d.groupBy((F.col("y") / F.col("x")).alias("ratio")).agg(F.sum(F.col("x") ** 2 / F.col("s") ** 2).alias("w"))
    v = running(v, "ratio", {"w": F.col("w")}).withColumn("p", (F.col("run_w") - F.col("w") / 2) / F.col("all_w"))
    lo = v.where("p <= 0.5").agg(F.max(F.struct("p", "ratio")).alias("a")).first().a
    hi = v.where("p > 0.5").agg(F.min(F.struct("p", "ratio")).alias("a")).first().a
    median = lo.ratio + (hi.ratio - lo.ratio) * (0.5 - lo.p) / (hi.p - lo.p) if lo and hi else (lo or hi).ratio
    return {"ivw": ivw, "ivw_se": math.sqrt(max(q / (r[6] - 1), 1.0) / r[3]) if r[6] > 1 else math.nan, "egger": slope, "egger_se": math.sqrt(s2 * r[0] / det), "egger_intercept": inter, "weighted_median": median, "q": q, "q_p": dist.chi2_sf(q, r[6] - 1) if r[6] > 1 else math.nan}


def meta(df: DataFrame, effect: str, se: str) -> dict[str, float]:
    """Fixed and random effects pooling (DerSimonian-Laird) with heterogeneity."""
    d = df.select(num(effect).alias("e"), num(se).alias("s")).dropna().where("s > 0")
    w = 1 / F.col("s") ** 2
    n, sw, swe, swee, sww = d.agg(F.count("*"), F.sum(w), F.sum(w * F.col("e")), F.sum(w * F.col("e") ** 2), F.sum(w * w)).first()
    q = swee - swe**2 / sw
    tau2 = max((q - (n - 1)) / (sw - sww / sw), 0.0) if n > 1 else 0.0
    v = 1 / (F.col("s") ** 2 + tau2)
    rw, rwe = d.agg(F.sum(v), F.sum(v * F.col("e"))).first()
    return {"fixed": swe / sw, "fixed_se": math.sqrt(1 / sw), "random": rwe / rw, "random_se": math.sqrt(1 / rw), "tau2": tau2, "q": q, "i2": max(0.0, 1 - (n - 1) / q) if q > 0 else 0.0}


# ---------------------------------------------------------------- power
def power_means(delta: float, sd: float, n_per_arm: int, alpha: float = 0.05) -> float:
    z = dist.norm_ppf(1 - alpha / 2)
    shift = abs(delta) / (sd * math.sqrt(2 / n_per_arm))
    return dist.norm_cdf(shift - z) + dist.norm_cdf(-shift - z)


def sample_size(delta: float, sd: float, power: float = 0.8, alpha: float = 0.05, icc: float = 0.0, cluster_size: int = 1) -> int:
    """Rows per arm for a difference of means, inflated for clusters."""
    z = dist.norm_ppf(1 - alpha / 2) + dist.norm_ppf(power)
    return math.ceil(2 * (z * sd / delta) ** 2 * (1 + (cluster_size - 1) * icc))


def minimum_effect(sd: float, n_per_arm: int, power: float = 0.8, alpha: float = 0.05) -> float:
    return (dist.norm_ppf(1 - alpha / 2) + dist.norm_ppf(power)) * sd * math.sqrt(2 / n_per_arm)


def icc(df: DataFrame, y: str, cluster: str) -> float:
    """Intraclass correlation from the one-way analysis of variance."""
    c = df.select(num(y).alias("y"), F.col(cluster).alias("c")).dropna().groupBy("c").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    k, n, ss, nn, grand = c.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("v")), F.sum(F.col("n") ** 2), F.sum(F.col("n") * F.col("m")) / F.sum("n")).first()
    between = c.agg(F.sum(F.col("n") * (F.col("m") - grand) ** 2)).first()[0] / (k - 1)
    within = ss / (n - k)
    n0 = (n - nn / n) / (k - 1)
    return (between - within) / (between + (n0 - 1) * within)


def synthetic_did(df: DataFrame, y: str, unit: str, time: str, treated: list, start) -> dict[str, float]:
    """Arkhangelsky and others' estimator: unit and time weights, then a weighted difference in differences.

    The balanced units x periods matrix is bounded as in ``synthetic_control``.
    """
    us, ts, m = _wide(df, y, unit, time)
    keep = ~np.isnan(m).any(axis=0)
    us, m = [u for u, k in zip(us, keep) if k], m[:, keep]
    pre, own = np.array([t < start for t in ts]), np.array([u in set(treated) for u in us])
    donors, t0 = m[:, ~own], int(pre.sum())
    goal, n1, t1 = m[:, own].mean(axis=1), int(own.sum()), int((~pre).sum())
    noise = np.diff(donors[pre], axis=0).std(ddof=1)
    zeta = (n1 * t1) ** 0.25 * noise
    flat = lambda a: a - a.mean(axis=0)  # noqa: E731  an intercept
    n0 = donors.shape[1]
    omega = simplex(np.concatenate([flat(goal[pre]), np.zeros(n0)]), np.vstack([flat(donors[pre]), zeta * math.sqrt(t0) * np.eye(n0)]))
    small = 1e-6 * noise
    lam = simplex(np.concatenate([flat(donors[~pre].mean(axis=0)), np.zeros(t0)]), np.vstack([flat(donors[pre].T), small * math.sqrt(n0) * np.eye(t0)]))
    change = lambda a: a[~pre].mean(axis=0) - lam @ a[pre]
    return {"att": float(change(goal) - change(donors) @ omega), "donors_used": float((omega > 1e-4).sum()), "periods_used": float((lam > 1e-4).sum())}


def mr_leave_one_out(df: DataFrame, variant: str, bx: str, by: str, se_y: str) -> DataFrame:
    """(variant, ivw, std_error) without each variant in turn, from sums less the variant's own part."""
    d = df.select(F.col(variant).alias("variant"), num(bx).alias("x"), num(by).alias("y"), num(se_y).alias("s")).dropna().where("x <> 0 and s > 0")
    d = d.select("variant", (F.col("x") ** 2 / F.col("s") ** 2).alias("xx"), (F.col("x") * F.col("y") / F.col("s") ** 2).alias("xy"))
    xx, xy = d.agg(F.sum("xx"), F.sum("xy")).first()
    left = xx - F.col("xx")
    return d.where(left > 0).select("variant", ((xy - F.col("xy")) / left).alias("ivw"), (1 / F.sqrt(left)).alias("std_error"))


def panel_unit_root(df: DataFrame, y: str, unit: str, time: str) -> dict[str, float]:
    """Mean over units of the Dickey-Fuller t with an intercept, from each unit's sums (Im, Pesaran and Shin's t-bar)."""
    w = Window.partitionBy("u").orderBy("t")
    d = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), num(y).alias("y")).dropna()
    d = d.select("u", F.lag("y").over(w).alias("x"), (F.col("y") - F.lag("y").over(w)).alias("dy")).dropna()
    per = d.groupBy("u").agg(F.count("*").alias("n"), F.regr_sxx("dy", "x").alias("xx"), F.regr_sxy("dy", "x").alias("xy"), F.regr_syy("dy", "x").alias("yy")).where("n > 3 and xx > 0")
    b = F.col("xy") / F.col("xx")
    t = b / F.sqrt((F.col("yy") - b * F.col("xy")) / (F.col("n") - 2) / F.col("xx"))
    r = per.agg(F.avg(t), F.count("*")).first()
    return {"t_bar": r[0], "units": r[1]}
