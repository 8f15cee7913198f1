"""Absorbed effects, solved on tables of levels.

The normal equations of the effects need sums per level and per pair of levels only.  The effect with
the most levels, the long one, is eliminated: its equations are diagonal.  Where the other effects have
few levels, these become columns of a table with a row per level of the long effect, whose cross-products
close the system in one pass.  Otherwise conjugate gradients run on the equations of the short effects; a
step joins the table of level combinations with one number per column and level, and adds up by level.

Rows are read to make these tables and to be handed out, never within the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from abacist.operators.core import DataInsufficient, Fit, inverse, meat, names_of, usable
from abacist.operators.panel import written

#: Levels of all effects but the long one that become columns; with more, conjugate gradients.
SHORT = 48
#: Steps of conjugate gradients; without convergence an error says so.
STEPS = 1000


def prune(df: DataFrame, effects: list[str], y: str | None = None, singletons: bool = True) -> tuple[DataFrame, int, int]:
    """(rows, dropped as singletons, dropped as separated), until nothing is left to drop.

    Singletons are alone in a level of some effect.  With ``y``, rows of a level whose outcomes are all zero are
    separated: no finite effect fits them.  The rounds run on counts per combination of levels.
    """
    spark = df.sparkSession
    start = written(df.groupBy(*effects).agg(F.count("*").alias("__n"), F.sum(F.abs(y) if y else F.lit(1.0)).alias("__y")), spark)
    size = lambda c: c.agg(F.sum("__n")).first()[0] or 0

    def drop(cells: DataFrame, bad: Column) -> DataFrame:
        while True:
            gone = None
            for f in effects:
                one = cells.groupBy(F.col(f).alias("__level")).agg(F.sum("__n").alias("__all"), F.sum("__y").alias("__out")).where(bad).select(F.lit(f).alias("__f"), F.col("__level").cast("string").alias("__l"))
                gone = one if gone is None else gone.unionByName(one)
            gone = written(gone, spark)
            if gone.isEmpty():
                return cells
            for f in effects:
                cells = cells.join(gone.where(F.col("__f") == f), F.col(f).cast("string") == F.col("__l"), "left_anti")
            cells = written(cells, spark)

    before = size(start)
    kept = drop(start, F.col("__all") == 1) if singletons else start
    middle = size(kept)
    kept = drop(kept, F.col("__out") == 0) if y else kept
    after = size(kept)
    if before == after:
        return df, 0, 0
    cells = kept.select(*[F.col(f).alias(f"__k_{f}") for f in effects])
    return df.join(cells, [F.col(f) == F.col(f"__k_{f}") for f in effects], "left_semi"), before - middle, middle - after


@dataclass
class Absorbed:
    """What the effects take out of each column: a table (``__level``, ``e_<column>``) per effect, and the Gram of what is left."""

    levels: dict[str, DataFrame]
    gram: np.ndarray
    rounds: int
    other: dict[str, float]


def absorbed(df: DataFrame, cols: list[str], effects: list[str], weight: str | None = None, also: dict[str, Column] | None = None, tol: float = 1e-10) -> Absorbed:
    """Weighted projection of the columns on the effects; ``also``: further sums over the rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    n = df.agg(*[F.count_distinct(f) for f in effects]).first() if len(effects) > 1 else [0]
    order = sorted(range(len(effects)), key=lambda i: -n[i])
    long, short = effects[order[0]], [effects[i] for i in order[1:]]
    if sum(n[i] for i in order[1:]) <= SHORT:
        return _by_columns(df, cols, long, short, w, also or {})
    return _by_gradients(df, cols, long, short, w, also or {}, tol)


def _totals(df: DataFrame, cols: list[str], by: list[str], w: Column, also: dict[str, Column]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return df.groupBy(*by).agg(F.sum(w).alias("__w"), *[F.sum(w * F.col(c)).alias(f"__s_{c}") for c in cols], *[F.sum(w * F.col(a) * F.col(b)).alias(f"__p{i}") for i, (a, b) in enumerate(pairs)], *[F.sum(c).alias(f"__o_{n}") for n, c in also.items()])


def _sums(rows: list, cols: list[str], also: dict[str, Column]) -> tuple[np.ndarray, dict[str, float]]:
    """(sum of the columns' products, further sums) over collected totals."""
    k, at = len(cols), 0
    gram = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = math.fsum(r[f"__p{at}"] for r in rows)
            at += 1
    return gram, {n: math.fsum(r[f"__o_{n}"] for r in rows) for n in also}


def _by_columns(df: DataFrame, cols: list[str], long: str, short: list[str], w: Column, also: dict[str, Column]) -> Absorbed:
    spark, k = df.sparkSession, len(cols)
    # at most SHORT levels in all, so their combinations are few
    few = _totals(df, cols, short, w, also).collect()
    if not few or few[0]["__w"] is None:
        raise DataInsufficient("no usable rows")
    levels = [(f, v) for f in short for v in sorted({r[f] for r in few})]
    J = len(levels)
    own, by = np.zeros((J, J)), np.zeros((J, k))
    for r in few:
        at = [i for i, (f, v) in enumerate(levels) if r[f] == v]
        own[np.ix_(at, at)] += r["__w"]
        by[at] += [r[f"__s_{c}"] for c in cols]
    gram, other = _sums(few, cols, also)
    held = [F.sum(F.when(F.col(f) == F.lit(v), w).otherwise(0.0)) for f, v in levels]
    table = df.groupBy(F.col(long).alias("__level")).agg(F.sum(w).alias("__w"), F.array(*held).alias("__j") if J else F.array().cast("array<double>").alias("__j"), F.array(*[F.sum(w * F.col(c)) for c in cols]).alias("__s"))
    table = written(table, spark)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((J + k, J + k))
        for b in batches:
            m = np.column_stack([b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for i in (1, 2)])
            total += m.T @ (m / b.column(0).to_numpy()[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    taken = np.zeros((J + k) ** 2)
    for r in table.select("__w", "__j", "__s").mapInArrow(products, "at long, v double").groupBy("at").agg(F.sum("v")).collect():
        taken[r[0]] = r[1]
    taken = taken.reshape(J + k, J + k)
    lhs, rhs = own - taken[:J, :J], by - taken[:J, J:]
    # the equations lack a rank for each connected part of the levels
    value = np.linalg.pinv(lhs, rcond=1e-12, hermitian=True) @ rhs if J else np.zeros((0, k))
    left = gram - taken[J:, J:] - rhs.T @ value
    out = {}
    less = lambda i: sum((F.lit(float(value[j, i])) * F.col("__j")[j] for j in range(J)), F.lit(0.0))
    out[long] = table.select("__level", *[((F.col("__s")[i] - less(i)) / F.col("__w")).alias(f"e_{c}") for i, c in enumerate(cols)])
    for f in short:
        rows = [(v, *map(float, value[i])) for i, (g, v) in enumerate(levels) if g == f]
        out[f] = spark.createDataFrame(rows, ", ".join([f"__level {df.schema[f].dataType.simpleString()}", *[f"`e_{c}` double" for c in cols]]))
    return Absorbed(out, (left + left.T) / 2, 1, other)


def _by_gradients(df: DataFrame, cols: list[str], long: str, short: list[str], w: Column, also: dict[str, Column], tol: float) -> Absorbed:
    """Each column has its own scalars, but all share the joins.  Equations are scaled by the weight of their level."""
    spark, k = df.sparkSession, len(cols)
    gram, other = _sums(_totals(df, cols, [], w, also).collect(), cols, also)
    cells = written(df.groupBy(long, *short).agg(F.sum(w).alias("__w"), *[F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]), spark)
    every = [long, *short]
    K = range(k)

    def by_level(d: DataFrame, names: list[str], values: list[Column]) -> DataFrame:
        """Values added up by level of each short effect: (f, level, ...)."""
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("string").alias("level")) for i, f in enumerate(short)]))
        picked = d.select(each.alias("__e"), *[v.alias(n) for n, v in zip(names, values)])
        return picked.groupBy(F.col("__e.f").alias("f"), F.col("__e.level").alias("level")).agg(*[F.sum(n).alias(n) for n in names])

    def handed(d: DataFrame, table: DataFrame, column: str, names: list[str]) -> DataFrame:
        """``d`` with the sum over short effects of a column of the level table, one for each of ``names``."""
        for i, f in enumerate(short):
            one = table.where(F.col("f") == i).select(F.col("level").alias("__l"), *[F.col(f"{column}{j}").alias(f"__h{i}_{j}") for j in K])
            d = d.join(one, F.col(f).cast("string") == F.col("__l")).drop("__l")
        return d.select("*", *[sum((F.col(f"__h{i}_{j}") for i in range(len(short))), F.lit(0.0)).alias(n) for j, n in enumerate(names)]).drop(*[f"__h{i}_{j}" for i in range(len(short)) for j in K])

    per_long = cells.groupBy(F.col(long).alias("__g")).agg(F.sum("__w").alias("__d"), *[F.sum(f"s{j}").alias(f"t{j}") for j in K])
    per_long = written(per_long, spark)
    with_long = cells.join(per_long, F.col(long) == F.col("__g"))
    start = by_level(with_long, ["w", *[f"r{j}" for j in K]], [F.col("__w"), *[F.col(f"s{j}") - F.col("__w") * F.col(f"t{j}") / F.col("__d") for j in K]])
    state = start.select("f", "level", "w", *[F.lit(0.0).alias(f"x{j}") for j in K], *[F.col(f"r{j}") for j in K], *[(F.col(f"r{j}") / F.col("w")).alias(f"p{j}") for j in K])
    state = written(state, spark)
    # what may be left: in proportion to the columns' own scale
    goal = tol**2 * np.maximum(np.diag(gram), 1e-300)
    rounds, open_ = 0, np.ones(k, dtype=bool)
    while open_.any():
        if rounds == STEPS:
            raise DataInsufficient(f"absorbed effects did not converge in {STEPS} rounds")
        got = handed(cells.select(*every, "__w"), state, "p", [f"h{j}" for j in K])
        mean = got.groupBy(F.col(long).alias("__g")).agg(*[(F.sum(F.col("__w") * F.col(f"h{j}")) / F.sum("__w")).alias(f"m{j}") for j in K])
        q = by_level(got.join(mean, F.col(long) == F.col("__g")), [f"q{j}" for j in K], [F.col("__w") * (F.col(f"h{j}") - F.col(f"m{j}")) for j in K])
        # the products of a step are taken while its table is written
        seen, kinds = Observation(), {"pq": False, "rp": False, "rr": True, "rq": True, "qq": True}
        product = lambda x, j: F.sum(F.col(f"{x[0]}{j}") * F.col(f"{x[1]}{j}") / (F.col("w") if kinds[x] else 1.0)).alias(f"{x}{j}")  # noqa: E731, B023
        state = written(state.join(q, ["f", "level"]).observe(seen, *[product(x, j) for j in K for x in kinds]), spark)
        pq, rp, rr, rq, qq = (np.array([seen.get[f"{x}{j}"] or 0.0 for j in K]) for x in kinds)
        open_ = (rr > goal) & (pq > 0)
        a = np.where(open_, rp / np.where(open_, pq, 1.0), 0.0)
        new = rr - 2 * a * rq + a * a * qq  # to rounding of ``rr``
        b = np.where(open_, np.maximum(new, 0.0) / np.where(open_, rr, 1.0), 0.0)
        r = {j: F.col(f"r{j}") - float(a[j]) * F.col(f"q{j}") for j in K}
        state = state.select("f", "level", "w", *[(F.col(f"x{j}") + float(a[j]) * F.col(f"p{j}")).alias(f"x{j}") for j in K], *[r[j].alias(f"r{j}") for j in K], *[(r[j] / F.col("w") + float(b[j]) * F.col(f"p{j}")).alias(f"p{j}") for j in K])
        rounds += 1
        open_ &= (new > goal) | (rr * 1e-14 > goal)
    state = written(state, spark)
    got = handed(cells, state, "x", [f"h{j}" for j in K])
    table = written(got.groupBy(F.col(long).alias("__level")).agg(*[(F.sum(F.col(f"s{j}") - F.col("__w") * F.col(f"h{j}")) / F.sum("__w")).alias(f"e_{c}") for j, c in enumerate(cols)]), spark)
    # the effects' share of the columns' products: level values against level sums
    fitted = got.join(table, F.col(long) == F.col("__level"))
    share = np.array(fitted.agg(*[F.sum((F.col(f"h{i}") + F.col(f"e_{cols[i]}")) * F.col(f"s{j}")) for i in K for j in K]).first(), dtype=float).reshape(k, k)
    left = gram - share
    out = {long: table}
    for i, f in enumerate(short):
        out[f] = state.where(F.col("f") == i).select(F.col("level").cast(df.schema[f].dataType).alias("__level"), *[F.col(f"x{j}").alias(f"e_{c}") for j, c in enumerate(cols)])
    return Absorbed(out, (left + left.T) / 2, rounds, other)


def handed_out(df: DataFrame, levels: dict[str, DataFrame], into: dict[str, Column], names: list[str]) -> DataFrame:
    """``df`` with ``into`` computed beside ``a_<name>``, the sum over effects of the row's level values."""
    out = df
    for i, (f, table) in enumerate(levels.items()):
        one = table.select(F.col("__level").alias(f"__l{i}"), *[F.col(f"e_{n}").alias(f"__e{i}_{n}") for n in names])
        out = out.join(one, F.col(f) == F.col(f"__l{i}"))
    out = out.withColumns({f"a_{n}": sum((F.col(f"__e{i}_{n}") for i in range(len(levels))), F.lit(0.0)) for n in names})
    return out.withColumns(into).select(*df.columns, *[c for c in into if c not in df.columns])


def fepois(df: DataFrame, y, x: list, effects: list[str], *, vcov: str = "nonrobust", cluster: str | None = None, weights: str | None = None, singletons: bool = True, separation: bool = True, tol: float = 1e-8, most: int = 50) -> Fit:
    """Poisson regression with absorbed effects.  vcov: nonrobust, HC1, or clustered by ``cluster``.

    Rows with a null drop, and so do singletons and separated rows (``prune``).  Each step projects the working
    response on the effects by their level tables; rows are read twice a step and never swept.  Standard errors
    count every level less one per effect.  Raises if the outcome is negative or the steps do not converge.
    """
    spark = df.sparkSession
    yc = y[1] if isinstance(y, tuple) else F.col(y)
    xs = names_of(x)
    names = [f"__x{i}" for i in range(len(xs))]
    cols = {"__y": yc, **dict(zip(names, xs.values())), **({"__v": F.col(weights)} if weights else {})}
    d = usable(df, cols, tuple(dict.fromkeys([*effects, *([cluster] if cluster else [])])))
    if weights:
        d = d.where("__v > 0")
    d, alone, separated = prune(d, effects, "__y" if separation else None, singletons)
    d = written(d, spark)
    v = F.col("__v") if weights else F.lit(1.0)
    first = d.agg(F.count("*"), F.min("__y"), F.sum(v * F.col("__y")) / F.sum(v), *[F.avg(c) for c in names], *[F.count_distinct(f) for f in effects]).first()
    n, k = first[0], len(names)
    if not n or first[1] < 0:
        raise DataInsufficient("no usable rows" if not n else "a Poisson outcome is below zero")
    # centred columns keep the products well scaled; the effects take up the shift
    d = d.withColumns({c: F.col(c) - F.lit(float(m)) for c, m in zip(names, first[3 : 3 + k])})
    counts = first[3 + k :]
    deviance, found, beta = math.inf, None, np.zeros(k)
    eta = F.log((F.col("__y") + float(first[2])) / 2)
    for step in range(most):
        rows = d if found is None else handed_out(d, found, {}, [])
        if found is not None:
            rows = handed_out(d, found, {"__eta": F.col("a_fe") + sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, names)), F.lit(0.0))}, ["fe"])
        else:
            rows = d.withColumn("__eta", eta)
        rows = rows.withColumn("__eta", F.least(F.greatest("__eta", F.lit(-30.0)), F.lit(30.0)))
        mu = F.exp("__eta")
        rows = rows.withColumns({"__mu": v * mu, "__z": F.col("__eta") + (F.col("__y") - mu) / mu})
        own = F.when(F.col("__y") > 0, F.col("__y") * F.log(F.col("__y") / F.exp("__eta"))).otherwise(0.0) - (F.col("__y") - F.exp("__eta"))
        part = absorbed(rows, ["__z", *names], effects, "__mu", {"deviance": 2 * v * own, "loglik": v * (F.col("__y") * F.col("__eta") - F.exp("__eta"))})
        new = part.other["deviance"]
        done = found is not None and abs(new - deviance) <= tol * max(1.0, abs(new))
        bread = inverse(part.gram[1:, 1:]) if k else np.zeros((0, 0))
        if done:
            break
        deviance, beta = new, bread @ part.gram[1:, 0]
        found = {f: t.select("__level", (F.col("e___z") - sum((F.lit(float(b)) * F.col(f"e_{c}") for b, c in zip(beta, names)), F.lit(0.0))).alias("e_fe")) for f, t in part.levels.items()}
    else:
        raise DataInsufficient(f"no convergence in {most} steps")
    free = n - k - sum(c - 1 for c in counts)
    scale, df_r = (n / free if free > 0 else 1.0), math.inf
    if cluster or vcov != "nonrobust":
        left = handed_out(rows, part.levels, {c: F.col(c) - F.col(f"a_{c}") for c in names}, names)
        m, groups = meat(left, [F.col(c) * v * (F.col("__y") - F.exp("__eta")) for c in names], [cluster] if cluster else None)
        scale, df_r = (groups / (groups - 1) * (n - 1) / free, float(groups - 1)) if cluster else (scale, math.inf)
        variance = bread @ m @ bread * scale
    else:
        variance = bread * scale
    extra = {"deviance": deviance, "loglik": part.other["loglik"], "singletons": alone, "separated": separated, "levels": list(counts), "steps": step, "effects": found, "centre": dict(zip(xs, first[3 : 3 + k]))}
    return Fit(list(xs), beta, variance, n, df_r, extra)
