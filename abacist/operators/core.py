"""One-pass sufficient statistics and what is solved from them.

Operators reduce the data to counts, means and centred cross-products in one aggregation (the
stable updating form of ``covar_pop``), bring the k x k result to the driver and solve there.
Robust variances are a second aggregation over score columns; clustered ones group by cluster first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import num

SCHEMA = "term string, estimate double, std_error double, statistic double, p_value double, ci_low double, ci_high double"


class DataInsufficient(ValueError):
    """Too few usable rows, groups or contrasts for the estimator."""


@dataclass
class Fit:
    """Estimates with their variance; ``frame`` gives the coefficient table as a DataFrame."""

    names: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    n: int
    df: float = math.inf
    extra: dict = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.vcov), 0.0))

    def rows(self, alpha: float = 0.05) -> list[tuple]:
        q = dist.t_ppf(1 - alpha / 2, self.df)
        out = []
        for name, b, s in zip(self.names, self.beta.tolist(), self.se.tolist()):
            t = b / s if s > 0 else math.nan
            out.append((name, b, s, t, dist.two_sided(t, self.df), b - q * s, b + q * s))
        return out

    def frame(self, spark, alpha: float = 0.05) -> DataFrame:
        return spark.createDataFrame(self.rows(alpha), SCHEMA)

    def __getitem__(self, name: str) -> float:
        return float(self.beta[self.names.index(name)])

    def stderr(self, name: str) -> float:
        return float(self.se[self.names.index(name)])

    def predict(self, cols: dict[str, Column]) -> Column:
        out = F.lit(0.0)
        for name, b in zip(self.names, self.beta.tolist()):
            out = out + (F.lit(b) if name == "Intercept" else F.lit(b) * cols[name])
        return out


def usable(df: DataFrame, cols: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """The named columns as doubles, rows with a null or NaN dropped; ``keep`` columns as they are, not null."""
    out = df.select(*[num(c).alias(n) for n, c in cols.items()], *[F.col(k) for k in keep if k not in cols])
    return out.dropna()


def names_of(items) -> dict[str, Column]:
    """Column expressions by name from strings or (name, Column) pairs."""
    out = {}
    for x in items:
        name, col = (x, F.col(x)) if isinstance(x, str) else x
        out[name] = col
    return out


@dataclass
class Gram:
    n: float
    mean: np.ndarray
    cross: np.ndarray  # centred, summed
    rows: int


def gram(df: DataFrame, names: list[str], weight: str | None = None) -> Gram:
    """Counts, means and centred cross-products of the named double columns.

    Weighted sums take two aggregations, centred at the weighted means.
    """
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    if weight is None:
        row = df.agg(F.count("*"), *[F.avg(c) for c in names], *[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
        n, rows, mean = row[0], row[0], row[1 : 1 + len(names)]
        scale = float(n)
    else:
        w = F.col(weight)
        row = df.agg(F.count("*"), F.sum(w), *[F.sum(w * F.col(c)) / F.sum(w) for c in names]).first()
        rows, n, mean = row[0], row[1] or 0.0, row[2:]
        if not rows:
            raise DataInsufficient("no usable rows")
        d = [F.col(c) - F.lit(float(m)) for c, m in zip(names, mean)]
        row = [*[None] * (1 + len(names)), *df.agg(*[F.sum(w * d[i] * d[j]) for i, j in pairs]).first()]
        scale = 1.0
    if not rows:
        raise DataInsufficient("no usable rows")
    cross = np.zeros((len(names),) * 2)
    for (i, j), v in zip(pairs, row[1 + len(names) :]):
        cross[i, j] = cross[j, i] = v * scale
    return Gram(float(n), np.array(mean, dtype=float), cross, rows)


def grouped_gram(df: DataFrame, names: list[str], by: list[str]) -> dict[tuple, Gram]:
    """A Gram per group, in one aggregation; for few groups."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    k, out = len(by), {}
    for row in df.groupBy(*by).agg(F.count("*"), *[F.avg(c) for c in names], *[F.covar_pop(names[i], names[j]) for i, j in pairs]).collect():
        cross = np.zeros((len(names),) * 2)
        for (i, j), v in zip(pairs, row[k + 1 + len(names) :]):
            cross[i, j] = cross[j, i] = v * row[k]
        out[tuple(row[:k])] = Gram(float(row[k]), np.array(row[k + 1 : k + 1 + len(names)], dtype=float), cross, row[k])
    return out


def merged(grams: list[Gram]) -> Gram:
    """The Gram of the rows of all given ones together."""
    n = sum(g.n for g in grams)
    if not n:
        raise DataInsufficient("no usable rows")
    mean = sum(g.n * g.mean for g in grams) / n
    cross = sum(g.cross + g.n * np.outer(g.mean - mean, g.mean - mean) for g in grams)
    return Gram(n, mean, cross, sum(g.rows for g in grams))


def moments(g: Gram, x: list[int], intercept: bool = True) -> np.ndarray:
    """X'X over the columns ``x`` with the constant first."""
    m = g.mean[x]
    full = g.cross[np.ix_(x, x)] + g.n * np.outer(m, m)
    if not intercept:
        return full
    top = np.concatenate([[g.n], g.n * m])
    return np.vstack([top, np.column_stack([g.n * m, full])])


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse after scaling to a unit diagonal; a collinear column raises."""
    d = np.sqrt(np.maximum(np.diag(a), 0))
    if (d == 0).any():
        raise DataInsufficient("a column is constant or empty")
    s = a / np.outer(d, d)
    if np.linalg.cond(s) > 1e13:
        raise DataInsufficient("columns are collinear")
    return np.linalg.inv(s) / np.outer(d, d)


def solve_ls(g: Gram, y: int, x: list[int], intercept: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """(beta, inverse of X'X, residual sum of squares) of y on x, from the centred cross-products."""
    if not intercept:
        bread = inverse(moments(g, x, False))
        xy = g.cross[x, y] + g.n * g.mean[x] * g.mean[y]
        yy = g.cross[y, y] + g.n * g.mean[y] ** 2
        b = bread @ xy
        return b, bread, float(yy - b @ xy)
    m = g.mean[x]
    inner = inverse(g.cross[np.ix_(x, x)]) if x else np.zeros((0, 0))
    slope = inner @ g.cross[x, y]
    b = np.concatenate([[g.mean[y] - m @ slope], slope])
    corner = np.array([[1 / g.n + m @ inner @ m]])
    bread = np.block([[corner, -(m @ inner)[None, :]], [-(inner @ m)[:, None], inner]])
    return b, bread, float(g.cross[y, y] - slope @ g.cross[x, y])


def meat(df: DataFrame, scores: list[Column], by: list[str] | None = None) -> tuple[np.ndarray, int]:
    """(sum of outer products of the scores, number of rows or clusters); scores are summed per cluster first."""
    k = len(scores)
    cols = [f"__s{i}" for i in range(k)]
    if by is None:
        f = df.select(*[s.alias(c) for s, c in zip(scores, cols)])
    else:
        f = df.groupBy(*by).agg(*[F.sum(s).alias(c) for s, c in zip(scores, cols)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = f.agg(F.count("*"), *[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs]).first()
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1:]):
        out[i, j] = out[j, i] = v or 0.0
    return out, row[0]


def cluster_factor(kind: str, groups: int, n: int, k: int) -> float:
    """Small-sample factor of a clustered variance."""
    if groups <= 1 or kind == "none":
        return 1.0
    g = groups / (groups - 1)
    return {"cgm": g, "stata": g * (n - 1) / max(n - k, 1), "stacked": g * n / max(n - k, 1)}[kind]


def psd(v: np.ndarray) -> np.ndarray:
    w, u = np.linalg.eigh((v + v.T) / 2)
    return v if (w >= 0).all() else (u * np.maximum(w, 0)) @ u.T


def lagged_meat(df: DataFrame, scores: list[Column], order: str, lags: int, within: list[str] = []) -> np.ndarray:
    """Newey-West sum of autocovariances of the scores with Bartlett weights, along ``order`` within groups."""
    k = len(scores)
    f = df.select(*[s.alias(f"__s{i}") for i, s in enumerate(scores)], order, *[c for c in within if c != order])
    before = lagged(f, order, [f"__s{i}" for i in range(k)], lags, within)
    sums = [F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")) for i in range(k) for j in range(k)]
    sums += [F.sum(F.col(f"__s{i}") * F.col(f"__s{j}_{q}")) for q in range(1, lags + 1) for i in range(k) for j in range(k)]
    v = np.array([x or 0.0 for x in before.agg(*sums).first()]).reshape(lags + 1, k, k)
    return v[0] + sum((1 - q / (lags + 1)) * (v[q] + v[q].T) for q in range(1, lags + 1))


# ---------------------------------------------------------------- tasks of bounded size
#: Rows of a task that keeps a hash table of its rows' keys.
HELD = 400_000


def spread(df: DataFrame, keys: list[str], held: int | None = None) -> DataFrame:
    """``df`` partitioned by ``keys`` into tasks of about ``held`` rows, whatever the size of the table: one count, one shuffle.

    An aggregation or join by these keys needs no further shuffle, nor a hash table on the map side; meant for keys that
    seldom repeat, as all rows of a key are in one task.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / (held or HELD))), *keys)


# ---------------------------------------------------------------- running sums without a global sort
#: Cells of a column that exact quantiles count in, at least.
CELLS = 200


def in_cells(df: DataFrame, order: str, cells: int | None = None) -> DataFrame:
    """``df`` with ``__cell``: the quantile cell of ``order`` (double, not null); equal values share a cell.

    The cuts are approximate quantiles from one aggregation, so a cell holds about an equal share of
    the rows however the values are spread.
    """
    from pyspark.ml.feature import Bucketizer

    n = cells or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10 * n)).first()[0] or [0.0]
    splits = [-math.inf, *sorted({float(c) for c in cuts}), math.inf]
    return Bucketizer(splits=splits, inputCol=order, outputCol="__cell").transform(df)


def running(df: DataFrame, order: str, values: dict[str, Column], by: list[str] = [], *, down: bool = False, fn: str = "sum") -> DataFrame:
    """``df`` with ``run_<name>``, the running sum (max, min) of each value along ``order``, and ``all_<name>``, that of the group.

    ``order`` is a double column that does not repeat within a group; ``down`` runs from its highest
    value.  No task sorts a whole group: windows run inside quantile cells, and what lies before a
    cell comes from a window over one row per cell.
    """
    d = (df if "__cell" in df.columns else in_cells(df, order)).withColumns({f"__v_{n}": c for n, c in values.items()})
    f = {"sum": F.sum, "max": F.max, "min": F.min}[fn]
    along = lambda c: F.col(c).desc() if down else F.col(c).asc()
    totals = d.groupBy(*by, "__cell").agg(*[f(f"__v_{n}").alias(f"__v_{n}") for n in values])
    before = Window.partitionBy(*by).orderBy(along("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    keys = [*by, "__cell"]
    base = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[f(f"__v_{n}").over(before).alias(f"__b_{n}") for n in values], *[f(f"__v_{n}").over(every).alias(f"all_{n}") for n in values])
    met = [d[k].eqNullSafe(base[f"__k_{k}"]) for k in keys]
    inside = Window.partitionBy(*keys).orderBy(along(order)).rowsBetween(Window.unboundedPreceding, 0)
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}[fn]
    return d.join(base, met).select(*df.columns, *[both(f(f"__v_{n}").over(inside), F.col(f"__b_{n}")).alias(f"run_{n}") for n in values], *[f"all_{n}" for n in values])


#: Rows of a run within which ``lagged`` looks back.
RUN = 100_000


def as_number(df: DataFrame, c: str) -> Column:
    """The column as a double that never falls where it rises: numbers, dates, timestamps, booleans, strings by their first 6 bytes."""
    kind = dict(df.dtypes)[c]
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(c), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(c).cast("double")


def lagged(df: DataFrame, order: str, cols: list[str], lags: int, by: list[str] = [], run: int | None = None) -> DataFrame:
    """``df`` with ``<col>_<q>``, the value of ``col`` 1 to ``lags`` rows earlier along ``order`` within its group, null before the first.

    ``order`` is not null; equal values stand in any order.  No task sorts a table or a group: rows are numbered inside
    quantile cells from the counts of the cells before, cut into runs by number, and a run's last rows are handed to the next.
    """
    run = max(run or RUN, lags)
    d = in_cells(df.withColumn("__at", as_number(df, order)), "__at")
    keys = [*by, "__cell"]
    size = d.groupBy(*keys).agg(F.count("*").alias("__m"))
    ahead = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    base = size.select(*[F.col(c).alias(f"__k_{c}") for c in keys], F.coalesce(F.sum("__m").over(ahead), F.lit(0)).alias("__base"))
    place = F.col("__base") + F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    d = d.join(base, [d[c].eqNullSafe(base[f"__k_{c}"]) for c in keys]).select(*df.columns, place.alias("__i"))
    own = F.floor(F.col("__i") / run)
    late = F.col("__i") % run >= run - lags
    d = d.withColumn("__run", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*by, "__run").orderBy("__i")
    return d.withColumns({f"{c}_{q}": F.lag(c, q).over(w) for c in cols for q in range(1, lags + 1)}).where(F.col("__run") == own).drop("__i", "__run")


def quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] = []) -> DataFrame:
    """One row per group: ``by``, and ``q_<col>``, the exact interpolated quantiles at ``probs`` of each column, as an array.

    Approximate cuts make cells; counts per cell, combined on the map side, tell which cells hold the ranks that are
    asked for, and only the rows of these are aggregated to distinct values.  No task holds a column or a whole group.
    Nulls and NaN count as missing; a group without a value in any column has no row (one row of nulls where ``by`` is empty).
    """
    from pyspark.ml.feature import Bucketizer

    keys = [f"__by_{b}" for b in by]
    d = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *[num(c).alias(f"__c{i}") for i, c in enumerate(cols)])
    n = max(CELLS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = d.agg(*[F.percentile_approx(f"__c{i}", [j / n for j in range(1, n)], 10 * n) for i in range(len(cols))]).first()
    splits = [[-math.inf, *sorted({float(c) for c in row or [0.0]}), math.inf] for row in cuts]
    d = Bucketizer(splitsArray=splits, inputCols=[f"__c{i}" for i in range(len(cols))], outputCols=[f"__b{i}" for i in range(len(cols))], handleInvalid="keep").transform(d)
    long = d.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("__var"), F.col(f"__c{i}").alias("__value"), F.col(f"__b{i}").cast("int").alias("__cell")) for i in range(len(cols))]))).where("__value is not null")
    group, cell = [*keys, "__var"], [*keys, "__var", "__cell"]
    ranks = lambda a: [F.floor(a), F.ceil(a)]
    at = [(F.col("__all") - 1) * F.lit(float(p)) for p in probs]
    upto = Window.partitionBy(*group).orderBy("__cell")
    size = long.groupBy(*cell).agg(F.count("*").alias("__m"))
    size = size.withColumns({"__base": F.sum("__m").over(upto) - F.col("__m"), "__all": F.sum("__m").over(Window.partitionBy(*group))})
    asked = F.lit(False)
    for a in at:
        for r in ranks(a):
            asked = asked | ((F.col("__base") <= r) & (r < F.col("__base") + F.col("__m")))
    held = size.where(asked).select(*[F.col(c).alias(f"__h{i}") for i, c in enumerate(cell)], "__base", "__all")
    # a null key is a group like any other
    met = long.join(held, [F.col(c).eqNullSafe(F.col(f"__h{i}")) for i, c in enumerate(cell)])
    per = met.groupBy(*cell, "__base", "__all", "__value").agg(F.count("*").alias("__n"))
    per = per.withColumn("__run", F.col("__base") + F.sum("__n").over(Window.partitionBy(*cell).orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)))
    picks = []
    for j, a in enumerate(at):
        for name, r in zip(("lo", "hi"), ranks(a)):
            picks.append(F.max(F.when((F.col("__run") - F.col("__n") <= r) & (r < F.col("__run")), F.col("__value"))).alias(f"{name}{j}"))
    picked = per.groupBy(*group).agg(F.first("__all").alias("__all"), *picks)
    found = []
    for j, a in enumerate(at):
        lo, hi = F.col(f"lo{j}"), F.col(f"hi{j}")
        found.append(F.when(lo == hi, lo).otherwise((F.ceil(a) - a) * lo + (a - F.floor(a)) * hi))
    wide = picked.select(*keys, "__var", F.array(*found).alias("__q")).groupBy(*keys).agg(*[F.max(F.when(F.col("__var") == i, F.col("__q"))).alias(f"q_{c}") for i, c in enumerate(cols)])
    return wide.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *[f"q_{c}" for c in cols])
