"""Fixed effects, panel transformations and within estimators."""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abacist.operators.core import DataInsufficient, Fit, Gram, cluster_factor, gram, inverse, meat, names_of, psd, solve_ls, usable


def written(df: DataFrame, spark) -> DataFrame:
    """A Parquet table below the shared checkpoint folder, read back: lineage ends here and survives lost executors."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{root.rstrip('/')}/abacist/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that no later step reads."""
    spark, path = df.sparkSession, df._written_to
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.remove(path)


def _release() -> None:
    """Delete the written tables when the process ends."""
    spark = SparkSession.getActiveSession()
    while _made and spark is not None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be going down
            return


_made: list[str] = []
atexit.register(_release)


def with_levels(df: DataFrame, aggregates: dict[str, Column], level: str) -> DataFrame:
    """``df`` with aggregates of the row's level: combined on the map side and joined, so that a level with most rows is no single task."""
    m = df.groupBy(F.col(level).alias("__level")).agg(*[a.alias(n) for n, a in aggregates.items()])
    return df.join(m, F.col(level) == F.col("__level")).drop("__level")


def drop_singletons(df: DataFrame, effects: list[str]) -> DataFrame:
    """Rows whose level occurs once in some effect go, until none is left."""
    if len(effects) == 1:
        return with_levels(df, {"__n": F.count("*")}, effects[0]).where("__n > 1").drop("__n")
    from abacist.operators.absorb import prune

    return prune(df, effects)[0]


def within_levels(df: DataFrame, cols: list[str], effect: str) -> tuple[Gram, int]:
    """(Gram of the columns net of one effect, number of levels) over rows not alone in their level: one aggregation, no row is joined or written."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    per = df.groupBy(effect).agg(F.count("*").alias("__n"), *[F.covar_pop(cols[i], cols[j]).alias(f"__c{at}") for at, (i, j) in enumerate(pairs)]).where("__n > 1")
    row = per.agg(F.count("*"), F.sum("__n"), *[F.sum(F.col("__n") * F.col(f"__c{at}")) for at in range(len(pairs))]).first()
    if not row[0]:
        raise DataInsufficient("no usable rows")
    cross = np.zeros((len(cols),) * 2)
    for (i, j), v in zip(pairs, row[2:]):
        cross[i, j] = cross[j, i] = v
    return Gram(float(row[1]), np.zeros(len(cols)), cross, row[1]), row[0]


def demean(df: DataFrame, cols: list[str], effects: list[str], weight: str | None = None) -> DataFrame:
    """Columns net of fixed effects: means per level, joined, of one effect; of several, what ``absorb`` solves on level tables."""
    if len(effects) > 1:
        from abacist.operators.absorb import absorbed, handed_out

        part = absorbed(df, cols, effects, weight)
        return handed_out(df, part.levels, {c: F.col(c) - F.col(f"a_{c}") for c in cols}, cols)
    w = F.col(weight) if weight else F.lit(1.0)
    d = with_levels(df, {f"__m_{c}": F.sum(w * F.col(c)) / F.sum(w) for c in cols}, effects[0])
    return d.withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def feols(df: DataFrame, y, x: list, effects: list[str], *, vcov: str = "nonrobust", cluster: list[str] | str | None = None, weights: str | None = None, **_) -> Fit:
    """Least squares with absorbed effects; degrees of freedom count all levels less one per further effect."""
    cl = [cluster] if isinstance(cluster, str) else list(cluster or [])
    yc = y[1] if isinstance(y, tuple) else F.col(y)
    xs = names_of(x)
    cols = {"__y": yc, **{f"__x{i}": c for i, c in enumerate(xs.values())}, **({"__w": F.col(weights)} if weights else {})}
    d = usable(df, cols, tuple(dict.fromkeys([*effects, *cl])))
    names = ["__y", *[f"__x{i}" for i in range(len(xs))]]
    if len(effects) == 1 and not weights:
        g, count = within_levels(d, names, effects[0])
        levels = [count]
        if cl or vcov != "nonrobust":  # scores are sums over rows
            d = with_levels(d, {"__n": F.count("*"), **{f"__m_{c}": F.avg(c) for c in names}}, effects[0]).where("__n > 1")
            d = written(d.select(*[(F.col(c) - F.col(f"__m_{c}")).alias(c) for c in names], *cl), df.sparkSession)
    else:
        d = drop_singletons(d, effects)
        levels = d.agg(*[F.count_distinct(f) for f in effects]).first()
        d = written(demean(d, names, effects, "__w" if weights else None), df.sparkSession)
        g = gram(d, names, "__w" if weights else None)
    absorbed = sum(levels) - (len(effects) - 1)
    k = len(xs)
    free = g.rows - absorbed - k
    if free <= 0:
        raise DataInsufficient("no degrees of freedom left")
    g.mean[:] = 0
    b, bread, rss = solve_ls(g, 0, list(range(1, k + 1)), intercept=False)
    e = (F.col("__w") if weights else F.lit(1.0)) * (F.col("__y") - sum((F.lit(v) * F.col(c) for v, c in zip(b.tolist(), names[1:])), F.lit(0.0)))
    scores = [F.col(c) * e for c in names[1:]]
    df_r = float(free)
    if cl:
        v, least = np.zeros((k, k)), None
        nested = sum(l for f, l in zip(effects, levels) if f in cl)  # effects nested in a cluster cost no freedom
        k_eff = k + max(absorbed - nested, 0) + (1 if nested else 0)
        for bits in range(1, 1 << len(cl)):
            some = [c for i, c in enumerate(cl) if bits >> i & 1]
            m, groups = meat(d, scores, some)
            v += (-1) ** (len(some) + 1) * cluster_factor("stata", groups, g.rows, k_eff) * bread @ m @ bread
            least = groups if least is None or len(some) == 1 and groups < least else least
        v, df_r = (psd(v) if len(cl) > 1 else v), float(least - 1)
    elif vcov == "nonrobust":
        v = rss / free * bread
    else:
        m, _ = meat(d, scores)
        v = bread @ m @ bread * (g.rows / free if vcov == "HC1" else 1)
    return Fit(list(xs), b, v, g.rows, df_r, {"rss": rss, "absorbed": absorbed, "levels": list(levels), "r2_within": 1 - rss / g.cross[0, 0] if g.cross[0, 0] else math.nan})


def between(df: DataFrame, y: str, x: list[str], unit: str) -> Fit:
    """Regression of unit means."""
    from abacist.operators.regression import ols

    means = usable(df, names_of([y, *x]), (unit,)).groupBy(unit).agg(*[F.avg(c).alias(c) for c in [y, *x]])
    return ols(means, y, x)


def first_difference(df: DataFrame, y: str, x: list[str], unit: str, time: str) -> Fit:
    from abacist.operators.regression import ols

    w = Window.partitionBy(unit).orderBy(time)
    d = usable(df, names_of([y, *x]), (unit, time))
    d = d.select(unit, *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in [y, *x]]).dropna()
    return ols(d, y, x, intercept=False, cluster=unit)


def random_effects(df: DataFrame, y: str, x: list[str], unit: str) -> Fit:
    """Swamy-Arora: quasi-demeaned least squares."""
    from abacist.operators.regression import ols

    d = usable(df, names_of([y, *x]), (unit,))
    fe = feols(d, y, x, [unit])
    means = d.groupBy(unit).agg(F.count("*").alias("T"), *[F.avg(c).alias(c) for c in [y, *x]])
    be = ols(means, y, x)
    harmonic = means.agg(F.count("*") / F.sum(1 / F.col("T"))).first()[0]
    s_e = fe.extra["rss"] / (fe.n - fe.extra["absorbed"] - len(x))
    s_u = max(be.extra["rss"] / (be.n - len(x) - 1) - s_e / harmonic, 0.0)
    theta = 1 - F.sqrt(F.lit(s_e) / (F.lit(s_e) + F.col("__n") * F.lit(s_u)))
    leveled = with_levels(d, {"__n": F.count("*"), **{f"__m_{c}": F.avg(c) for c in [y, *x]}}, unit)
    q = leveled.select(theta.alias("__t"), *[(F.col(c) - theta * F.col(f"__m_{c}")).alias(c) for c in [y, *x]])
    fit = ols(q.withColumn("__one", 1 - F.col("__t")), y, [("Intercept", F.col("__one")), *x], intercept=False)
    fit.extra |= {"sigma_e": math.sqrt(s_e), "sigma_u": math.sqrt(s_u)}
    return fit


def mundlak(df: DataFrame, y: str, x: list[str], unit: str) -> Fit:
    """Pooled regression with unit means added, clustered by unit."""
    from abacist.operators.regression import ols

    d = usable(df, names_of([y, *x]), (unit,))
    return ols(with_levels(d, {f"mean_{c}": F.avg(c) for c in x}, unit), y, [*x, *[f"mean_{c}" for c in x]], cluster=unit)


def lag_lead(df: DataFrame, col: str, unit: str, time: str, lags: int = 1, leads: int = 0) -> DataFrame:
    w = Window.partitionBy(unit).orderBy(time)
    out = {f"L{i}_{col}": F.lag(col, i).over(w) for i in range(1, lags + 1)} | {f"F{i}_{col}": F.lead(col, i).over(w) for i in range(1, leads + 1)}
    return df.withColumns(out)


def event_time(time: Column, first: Column) -> Column:
    return F.when(first.isNotNull() & (first > 0), time - first)
