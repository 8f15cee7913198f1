"""Descriptive tables and data preparation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import num
from abacist.operators.core import quantiles, running


def sumstats(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """n, mean, sd, min, quartiles, max of each column, per group, one row per column; quartiles are exact."""
    by = by or []
    simple = [("n", F.count), ("mean", F.avg), ("sd", F.stddev), ("min", F.min), ("max", F.max)]
    wide = df.select(*[F.col(b).alias(f"__k_{b}") for b in by], *[num(c).alias(c) for c in cols]).groupBy(*[f"__k_{b}" for b in by]).agg(*[f(F.col(c)).alias(f"{c}|{s}") for c in cols for s, f in simple])
    q = quantiles(df, cols, [0.25, 0.5, 0.75], by)
    both = wide.join(q, [wide[f"__k_{b}"].eqNullSafe(q[b]) for b in by], "left") if by else wide.crossJoin(F.broadcast(q))  # one row each
    value = lambda c, s: F.col(f"`{c}|{s}`").alias(s)
    part = lambda c, i, s: F.col(f"`q_{c}`")[i].alias(s)
    rows = [F.struct(F.lit(c).alias("variable"), *[value(c, s) for s in ("n", "mean", "sd", "min")], *[part(c, i, s) for i, s in enumerate(("p25", "median", "p75"))], value(c, "max")) for c in cols]
    return both.select(*[F.col(f"__k_{b}").alias(b) for b in by], F.inline(F.array(*rows)))


def tab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Cross table in long form with margins: null row or col marks a total (grouping sets)."""
    d = df.select(row, col).dropna()
    return d.cube(row, col).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where("level < 4").select(row, col, "n", "level")


def chi2_independence(df: DataFrame, row: str, col: str) -> tuple[float, int, float]:
    """(chi-square, df, p) of independence; two-by-two tables take Yates's correction."""
    cells = df.select(row, col).dropna().groupBy(row, col).count()
    r, c = cells.groupBy(row).agg(F.sum("count").alias("r")), cells.groupBy(col).agg(F.sum("count").alias("c"))
    shape = cells.agg(F.count_distinct(row), F.count_distinct(col), F.sum("count")).first()
    met = cells.join(r, row).join(c, col)
    if shape[0] == shape[1] == 2:
        full = r.crossJoin(c).join(cells, [row, col], "left").fillna(0, ["count"])  # four cells
        e = F.col("r") * F.col("c") / shape[2]
        gap = F.abs(F.col("count") - e)
        stat = full.agg(F.sum(F.pow(gap - F.least(gap, F.lit(0.5)), F.lit(2)) / e)).first()[0]
    else:  # empty cells need no row: they are in the margins
        share = met.agg(F.sum(F.col("count") * F.col("count") / (F.col("r").cast("double") * F.col("c")))).first()[0]
        stat = shape[2] * (share - 1) if shape[2] else None
    free = (shape[0] - 1) * (shape[1] - 1)
    return stat, free, dist.chi2_sf(stat, free)


def winsor(df: DataFrame, cols: list[str], lower: float = 0.01, upper: float = 0.99, by: list[str] | None = None, trim: bool = False, suffix: str = "_w") -> DataFrame:
    """Adds each column clipped (or set to null with ``trim``) at its exact percentiles, per group."""
    by = by or []
    cuts = quantiles(df, cols, [lower, upper], by)
    cuts = cuts.select(*[F.col(b).alias(f"__k_{b}") for b in by], *[F.col(f"q_{c}").alias(f"__{c}") for c in cols])
    met = [df[b].eqNullSafe(cuts[f"__k_{b}"]) for b in by]
    out = (df.join(cuts, met, "left") if by else df.crossJoin(F.broadcast(cuts))).drop(*[f"__k_{b}" for b in by])  # one row without groups
    for c in cols:
        lo, hi, v = F.col(f"__{c}")[0], F.col(f"__{c}")[1], num(c)
        kept = F.when((v >= lo) & (v <= hi), v) if trim else F.when(v < lo, lo).when(v > hi, hi).otherwise(v)
        out = out.withColumn(c + suffix, kept).drop(f"__{c}")
    return out


def pwcorr(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise correlations with n and p, each over the rows where both are present; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    d = df.select(*[num(c).alias(c) for c in cols])
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    row = d.agg(*[x for a, b in pairs for x in (F.corr(a, b), F.count(F.when(both(a, b), 1)))]).first()
    out = []
    for k, (a, b) in enumerate(pairs):
        r, n = row[2 * k], row[2 * k + 1]
        t = r * math.sqrt((n - 2) / (1 - r * r)) if r is not None and n > 2 and abs(r) < 1 else math.nan
        out.append((a, b, r, n, dist.two_sided(t, n - 2) if n > 2 else math.nan))
    return df.sparkSession.createDataFrame(out, "a string, b string, r double, n long, p_value double")


def ranked(df: DataFrame, col: str, ranks: dict[str, str], by: list[str] = [], ascending: bool = True) -> DataFrame:
    """``df`` with ranks of ``col`` within groups: ``ranks`` names each new column and its rule for ties.

    Ties: average, min, max or dense (first is not offered, it has no order).  A null or NaN has no
    rank.  Ranks come from the distinct values, and are joined to the rows.
    """
    keys = [F.col(b).alias(f"__by_{b}") for b in by]
    per = df.select(*keys, num(col).alias("__value")).where("__value is not null").groupBy(*[f"__by_{b}" for b in by], "__value").agg(F.count("*").alias("__n"))
    per = running(per, "__value", {"n": F.col("__n"), "dense": F.lit(1)}, [f"__by_{b}" for b in by], down=not ascending)
    high, n = F.col("run_n"), F.col("__n")
    rule = {"min": high - n + 1, "max": high, "average": high - (n - 1) / 2, "dense": F.col("run_dense")}
    per = per.select(*[f"__by_{b}" for b in by], "__value", *[rule[r].cast("double").alias(name) for name, r in ranks.items()])
    met = [df[b].eqNullSafe(per[f"__by_{b}"]) for b in by] + [num(df[col]) == per["__value"]]
    return df.join(per, met, "left").drop("__value", *[f"__by_{b}" for b in by])


def balance_table(df: DataFrame, treat: str, cols: list[str], weight: str | None = None) -> DataFrame:
    """Means and spreads by arm, standardised difference, variance ratio and Welch's t, per covariate."""
    out = []
    for c in cols:
        d = df.select(num(treat).alias("t"), num(c).alias("x"), (num(weight) if weight else F.lit(1.0)).alias("w")).dropna()
        m = d.groupBy("t").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"), F.var_samp("x").alias("v"))
        arm = {r.t: r for r in m.collect()}
        if set(arm) != {0.0, 1.0}:
            raise ValueError("treat must be 0/1 with both arms present")
        a, b = arm[1.0], arm[0.0]
        se = math.sqrt(a.v / a.n + b.v / b.n)
        free = (a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)) if se else math.inf
        t = (a.m - b.m) / se if se else math.nan
        pooled = math.sqrt((a.v + b.v) / 2)
        out.append((c, a.m, b.m, (a.m - b.m) / pooled if pooled else math.nan, a.v / b.v if b.v else math.nan, t, dist.two_sided(t, free)))
    return df.sparkSession.createDataFrame(out, "variable string, mean_treated double, mean_control double, smd double, variance_ratio double, t double, p_value double")


def binscatter(df: DataFrame, y: str, x: str, bins: int = 20) -> DataFrame:
    """Means of y and x in equal-count bins of x, cut at exact quantiles (no global sort of the rows)."""
    d = df.select(num(y).alias("y"), num(x).alias("x")).dropna()
    cuts = quantiles(d, ["x"], [i / bins for i in range(1, bins)]).first()[0] or []
    at = F.lit(1)
    for c in sorted(set(cuts)):
        at = at + (F.col("x") > F.lit(c)).cast("int")
    return d.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.stddev("y").alias("sd_y"))


def kdensity(df: DataFrame, x: str, points: int = 512, bandwidth: float | None = None, cells: int = 4096) -> DataFrame:
    """Gaussian kernel density on a grid, from a fine histogram (rows are read twice, never sorted)."""
    d = df.select(num(x).alias("x")).dropna()
    n, sd, lo, hi = d.agg(F.count("*"), F.stddev("x"), F.min("x"), F.max("x")).first()
    q = quantiles(d, ["x"], [0.25, 0.75]).first()[0]
    spread = min(sd, (q[1] - q[0]) / 1.349) if q[1] > q[0] else sd
    h = bandwidth or 0.9 * spread * n ** -0.2
    step = (hi - lo) / cells or 1.0
    hist = d.groupBy(F.least(F.floor((F.col("x") - lo) / step), F.lit(cells - 1)).alias("cell")).agg(F.count("*").alias("n"), F.avg("x").alias("m"))
    grid = df.sparkSession.range(points).select((F.lit(lo - 3 * h) + F.col("id") * ((hi - lo + 6 * h) / (points - 1))).alias("x"))
    z = (F.col("x") - F.col("m")) / h
    # both sides are bounded: the grid by ``points``, the histogram by ``cells``
    return grid.join(F.broadcast(hist)).groupBy("x").agg((F.sum(F.col("n") * F.exp(-z * z / 2)) / (n * h * math.sqrt(2 * math.pi))).alias("density"))


def fingerprint(df: DataFrame) -> str:
    """Digest of a table that does not depend on the order of rows."""
    h = F.xxhash64(*df.columns)
    row = df.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return f"{row[0]}-{(row[1] or 0) & (1 << 64) - 1:016x}-{int(row[2] or 0)}"
