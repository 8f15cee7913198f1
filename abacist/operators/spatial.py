"""Spatial regressions: geographically weighted, spatial lag and spatial error by maximum likelihood."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.operators.core import DataInsufficient, Fit, Gram, gram, moments
from abacist.operators.neighbours import placed
from abacist.operators.panel import written

LOCAL = {
    "bisquare": lambda u: F.when(u < 1, (1 - u * u) ** 2).otherwise(0.0),
    "gaussian": lambda u: F.exp(-0.5 * u * u),
    "exponential": lambda u: F.when(u < 1, F.exp(-u)).otherwise(0.0),
}


# ---------------------------------------------------------------- geographically weighted regression
def neighbourhood(points: DataFrame, y: str, x: list[str], coords: list[str], k: int, id_col: str) -> DataFrame:
    """(__z0, __z1 ..., near) of each distinct place: its ``k`` nearest points with their outcome and regressors, those at the place included."""
    return placed(points, points, k, coords, query_id=id_col, more=list(dict.fromkeys([y, *x])))


def gwr(points: DataFrame, y: str, x: list[str], coords: list[str], k: int, *, id_col: str, kern: str = "bisquare", near: DataFrame | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(local coefficients with errors and local R2 by point, overall figures).

    Each location's regression weighs its ``k`` nearest points, itself among them, by the kernel of the distance over the
    farthest one's.  Points at one place share their sums, which a task adds up from the place's list of neighbours, and
    each batch of locations is solved at once.  ``near`` may hold more neighbours than ``k``.  Rows with a null take no part.
    """
    spark = points.sparkSession
    d = points.select(F.col(id_col).alias("__id"), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([y, *x, *coords])]).dropna()
    d = written(d, spark)
    near = neighbourhood(d, y, x, coords, k, "__id") if near is None else near
    Z = [f"__z{i}" for i in range(len(coords))]
    used = near.select(*Z, F.slice("near", 1, k).alias("near"))
    met = used.select(*Z, F.sqrt(F.element_at("near", -1)["square"]).alias("__h"), F.explode("near").alias("v"))
    at = F.sqrt("v.square")
    met = met.select(*Z, "v.*", LOCAL[kern](F.when(F.col("__h") > 0, at / F.col("__h")).otherwise(at)).cast("double").alias("__w"))
    p = len(x) + 1
    design = [F.lit(1.0), *[F.col(c) for c in x]]
    w, out = F.col("__w"), F.col(y)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = met.groupBy(*Z).agg(
        F.array(*[F.sum(w * design[i] * design[j]) for i, j in pairs]).alias("__xx"), F.array(*[F.sum(w * w * design[i] * design[j]) for i, j in pairs]).alias("__ww"),
        F.array(*[F.sum(w * c * out) for c in design]).alias("__xy"), (F.sum(w * out * out) - F.sum(w * out) ** 2 / F.sum(w)).alias("__tss"),
    )
    place = d.select(F.col("__id").alias("query"), *[F.col(c).alias(z) for c, z in zip(coords, Z)], F.col(y).alias("__y"), F.array(*design).alias("__x"))
    rows = place.join(sums, Z).select("query", "__xx", "__ww", "__xy", "__tss", "__y", "__x", *Z)
    names = [f"b_{c}" for c in ["Intercept", *x]]
    schema = T.StructType([points.schema[id_col], *[T.StructField(c, T.DoubleType()) for c in [*names, *[f"c_{n}" for n in names], "predicted", "residual", "hat", "hat2", "tss", "y", *Z]]])

    def full(flat: np.ndarray) -> np.ndarray:
        m = np.zeros((len(flat), p, p))
        for at, (i, j) in enumerate(pairs):
            m[:, i, j] = m[:, j, i] = flat[:, at]
        return m

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xx, ww, xy, own = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for i in (1, 2, 3, 6))
            inv = np.linalg.pinv(full(xx), rcond=1e-14, hermitian=True)
            beta = np.einsum("nij,nj->ni", inv, xy)
            cc = inv @ full(ww) @ inv
            fit = (beta * own).sum(1)
            value = b.column(5).to_numpy()
            # the own point has weight one in every kernel
            hat, hat2 = np.einsum("ni,nij,nj->n", own, inv, own), np.einsum("ni,nij,nj->n", own, cc, own)
            cols = [b.column(0), *map(pa.array, beta.T), *map(pa.array, np.einsum("nii->in", cc)), *map(pa.array, (fit, value - fit, hat, hat2)), b.column(4), b.column(5), *b.columns[7:]]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    local = written(rows.mapInArrow(solve, schema), spark)
    n, rss, hat, hat2, tss = local.agg(F.count("*"), F.sum(F.col("residual") ** 2), F.sum("hat"), F.sum("hat2"), F.var_pop("y") * F.count("*")).first()
    if not n:
        raise DataInsufficient("no usable rows")
    s2 = rss / max(n - 2 * hat + hat2, 1e-6)
    fitted = met.select(*Z, "point", "__w").join(local.select(F.col(id_col).alias("point"), "residual"), "point").groupBy(*Z).agg(F.sum(w * F.col("residual") ** 2).alias("__rss"))
    # every location has its sum; where no local R2 is asked for, an outer join is dropped
    table = local.join(fitted, Z, "left")
    table = table.select(id_col, *names, *[F.sqrt(F.greatest(s2 * F.col(f"c_{c}"), F.lit(0.0))).alias(f"se_{c[2:]}") for c in names], "predicted", "residual", F.when(F.col("tss") > 0, 1 - F.col("__rss") / F.col("tss")).alias("local_r2"))
    log = n * math.log(rss / n) + n * math.log(2 * math.pi) if rss > 0 else -math.inf
    figures = {"n": float(n), "rss": rss, "trace": hat, "sigma2": s2, "r2": 1 - rss / tss if tss else math.nan, "aic": log + n + hat, "aicc": log + n * (n + hat) / max(n - hat - 2, 1e-6), "bic": log + hat * math.log(n)}
    return table, figures


def gwr_bandwidth(points: DataFrame, y: str, x: list[str], coords: list[str], *, id_col: str, least: int, most: int, kern: str = "bisquare") -> tuple[int, float]:
    """(number of neighbours, its corrected AIC) by golden-section search between ``least`` and ``most``; neighbours are searched once."""
    needed = [id_col, y, *x, *coords]
    d = points.select(*dict.fromkeys(needed)).dropna()
    d = d.select(id_col, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(needed[1:])])
    near, tried = neighbourhood(d, y, x, coords, most, id_col), {}

    def score(k: int) -> float:
        if k not in tried:
            tried[k] = gwr(d, y, x, coords, k, id_col=id_col, kern=kern, near=near)[1]["aicc"]
        return tried[k]

    a, b, g = least, most, (math.sqrt(5) - 1) / 2
    while b - a > 2:
        c, e = round(b - g * (b - a)), round(a + g * (b - a))
        if c == e:
            e += 1
        a, b = (a, e) if score(c) <= score(e) else (c, b)
    best = min(range(a, b + 1), key=score)
    return best, tried[best]


# ---------------------------------------------------------------- maximum likelihood
#: Nodes up to which traces are exact, probe vectors beyond, powers of the weights, and powers of one job.
EXACT, PROBES, ORDER, TOGETHER = 32, 16, 24, 4


class Powers:
    """Traces of powers of a weight table, and its products with vectors.

    With at most ``EXACT`` nodes, the probes are the unit vectors and traces are exact; otherwise signs hashed from node
    and probe, whose mean product is the trace.
    """

    def __init__(self, weights: DataFrame, nodes: DataFrame, seed: int = 0):
        self.spark, self.w = weights.sparkSession, written(weights.select("i", "j", "w"), weights.sparkSession)
        self.n = nodes.count()
        if self.n <= EXACT:
            ids = [r[0] for r in nodes.select("id").collect()]
            columns, self.scale = [(F.col("id") == F.lit(v)).cast("double") for v in ids], 1.0
        else:
            columns = [F.when(F.xxhash64("id", F.lit(p), F.lit(seed)) % 2 == 0, 1.0).otherwise(-1.0) for p in range(PROBES)]
            self.scale = 1.0 / PROBES
        self.names, self.signs = [f"u{p}" for p in range(len(columns))], columns
        self.start = written(nodes.select("id", *[c.alias(n) for c, n in zip(columns, self.names)]), self.spark)

    def lag(self, values: DataFrame, cols: list[str], base: DataFrame | None = None) -> DataFrame:
        """(id, columns): weighted sums over neighbours; nodes without any get zero.

        These joins are merged: vectors have a row per node, and each power would send one more of them through the driver.
        """
        v = values.select(F.col("id").alias("__j"), *cols).hint("merge")
        got = self.w.join(v, F.col("j") == F.col("__j")).groupBy(F.col("i").alias("__i")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"__{c}") for c in cols])
        base = (self.start if base is None else base).select("id")
        return base.join(got.hint("merge"), F.col("id") == F.col("__i"), "left").select("id", *[F.coalesce(f"__{c}", F.lit(0.0)).alias(c) for c in cols])

    def traces(self) -> np.ndarray:
        """Traces of the first ``ORDER`` powers; the first two exactly."""
        v, seen, out = self.start, [], []
        for m in range(1, ORDER + 1):
            v, obs = self.lag(v, self.names), Observation()
            v = v.observe(obs, sum((F.sum(F.col(n) * s) for n, s in zip(self.names, self.signs)), F.lit(0.0)).alias("t"))
            seen.append(obs)
            if m % TOGETHER == 0 or m == ORDER:
                v = written(v, self.spark)
                out += [(o.get["t"] or 0.0) * self.scale for o in seen]
                seen = []
        back = self.w.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("__b"))
        out[0] = self.w.where("i = j").agg(F.sum("w")).first()[0] or 0.0
        out[1] = self.w.join(back.hint("merge"), ["i", "j"]).agg(F.sum(F.col("w") * F.col("__b"))).first()[0] or 0.0
        return np.array(out)

    def resolved(self, rho: float, more: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
        """W (I - rho W)^-1 times the probes and the columns of ``more`` by id: (id, g_<column>)."""
        base = written(self.start.join(more.hint("merge"), "id"), self.spark)
        cols = [*self.names, *cols]
        g = base.select("id", *[F.lit(0.0).alias(c) for c in cols])
        for m in range(1, ORDER + 1):
            step = base.join(g.select(F.col("id").alias("__g"), *[F.col(c).alias(f"g_{c}") for c in cols]).hint("merge"), F.col("id") == F.col("__g")).select("id", *[(F.col(c) + rho * F.col(f"g_{c}")).alias(c) for c in cols])
            g = self.lag(step, cols)
            if m % TOGETHER == 0 or m == ORDER:
                g = written(g, self.spark)
        return base.join(g.select(F.col("id").alias("__g"), *[F.col(c).alias(f"g_{c}") for c in cols]).hint("merge"), F.col("id") == F.col("__g")), cols


def log_determinant(traces: np.ndarray, rho: float) -> float:
    """log |I - rho W| from traces of powers; beyond the last the traces count as constant, as those of standardised rows become."""
    m = np.arange(1, len(traces) + 1)
    rest = -math.log(1 - rho) - float((rho**m / m).sum())
    tail = (traces[-2] + traces[-1]) / 2 if len(traces) > 1 else traces[-1]
    return -float((rho**m / m * traces).sum()) - tail * rest


def _golden(f, a: float, b: float, steps: int = 200) -> float:
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if b - a < 1e-10:
            break
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def _lagged(df: DataFrame, weights: DataFrame, y: str, x: list[str], id_col: str) -> tuple[DataFrame, Powers, list[str]]:
    cols = ["__y", *[f"__x{i}" for i in range(len(x))]]
    d = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip([y, *x], cols)]).dropna()
    d = written(d, df.sparkSession)
    total = weights.groupBy("i").agg(F.sum("w").alias("__t")).where("__t <> 0")
    own = weights.join(total.hint("merge"), "i").select("i", "j", (F.col("w") / F.col("__t")).alias("w"))
    own = own.join(d.select(F.col("id").alias("i")).hint("merge"), "i", "left_semi").join(d.select(F.col("id").alias("j")).hint("merge"), "j", "left_semi")
    w = Powers(own, d.select("id"))
    lag = w.lag(d, cols).select(F.col("id").alias("__l"), *[F.col(c).alias(f"w{c}") for c in cols])
    return written(d.join(lag.hint("merge"), F.col("id") == F.col("__l")).drop("__l"), df.sparkSession), w, cols


def _blocks(g: Gram, cols: list[str]) -> np.ndarray:
    """Moments of (1, columns, lagged columns)."""
    return moments(g, list(range(2 * len(cols))))


def _likelihood(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: int, traces: np.ndarray, rho: float) -> tuple[float, np.ndarray, float]:
    """(minus the concentrated log likelihood, coefficients, variance) of y'y, X'y and X'X at rho."""
    beta = np.linalg.solve(c, b)
    s2 = max(float(a - b @ beta), 1e-300) / n
    return n / 2 * (math.log(2 * math.pi) + math.log(s2) + 1) - log_determinant(traces, rho), beta, s2


def sar(df: DataFrame, weights: DataFrame, y: str, x: list[str], *, id_col: str) -> Fit:
    """Spatial lag model y = rho W y + X b + e by maximum likelihood, with full-information errors.

    ``weights`` (i, j, w) are row-standardised; units without neighbours have a lag of zero.  The likelihood needs the
    cross-products of y, W y and X and the traces of powers of W; the driver searches rho.
    """
    d, w, cols = _lagged(df, weights, y, x, id_col)
    k, n = len(x), w.n
    m = _blocks(gram(d, [*cols, *[f"w{c}" for c in cols]]), cols)
    traces = w.traces()
    X, Y, WY = [0, *range(2, k + 2)], 1, k + 2
    at = lambda r: (m[Y, Y] - 2 * r * m[Y, WY] + r * r * m[WY, WY], m[X, Y] - r * m[X, WY], m[np.ix_(X, X)])
    rho = _golden(lambda r: _likelihood(*at(r), n, traces, r)[0], -0.99, 0.99)
    least, beta, s2 = _likelihood(*at(rho), n, traces, rho)
    fit = beta[0] + sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta[1:], cols[1:])), F.lit(0.0))
    got, names = w.resolved(rho, d.select("id", fit.alias("__fit"), *cols[1:]), ["__fit"])
    sums = [F.sum(sum((F.col(f"g_{u}") ** 2 for u in w.names), F.lit(0.0))), F.sum(F.col("g___fit") ** 2), F.sum("g___fit"), *[F.sum(F.col("g___fit") * F.col(c)) for c in cols[1:]]]
    row = np.array(got.agg(*sums).first(), dtype=float)
    tr, tr2 = _series(traces, rho)
    info = np.zeros((k + 3, k + 3))
    info[: k + 1, : k + 1] = m[np.ix_(X, X)] / s2
    info[: k + 1, k + 1] = info[k + 1, : k + 1] = row[2:] / s2
    info[k + 1, k + 1] = tr2 + row[0] * w.scale + row[1] / s2
    info[k + 1, k + 2] = info[k + 2, k + 1] = tr / s2
    info[k + 2, k + 2] = n / (2 * s2 * s2)
    v = np.linalg.inv(info)[: k + 2, : k + 2]
    return Fit(["Intercept", *x, "rho"], np.append(beta, rho), v, n, math.inf, {"loglik": -least, "sigma2": s2, "traces": traces})


def _series(traces: np.ndarray, rho: float) -> tuple[float, float]:
    """Traces of G and G G for G = W (I - rho W)^-1, with constant traces beyond the last."""
    m, tail = np.arange(len(traces)), (traces[-2] + traces[-1]) / 2
    one, two = rho**m, m * rho ** np.maximum(m - 1, 0)
    return float((one * traces).sum() + tail * (1 / (1 - rho) - one.sum())), float((two * traces).sum() + tail * (1 / (1 - rho) ** 2 - two.sum()))


def sem(df: DataFrame, weights: DataFrame, y: str, x: list[str], *, id_col: str) -> Fit:
    """Spatial error model y = X b + u, u = lambda W u + e by maximum likelihood; ``weights`` as in ``sar``."""
    d, w, cols = _lagged(df, weights, y, x, id_col)
    k, n = len(x), w.n
    # a constant's lag is one only where a unit has neighbours
    ones = w.lag(w.start.select("id", F.lit(1.0).alias("w1")), ["w1"]).select(F.col("id").alias("__l"), "w1")
    d = d.join(ones.hint("merge"), F.col("id") == F.col("__l")).drop("__l")
    m = moments(gram(d, [*cols, *[f"w{c}" for c in cols], "w1"]), list(range(2 * len(cols) + 1)))
    traces = w.traces()
    X, Y, WX, WY = [0, *range(2, k + 2)], 1, [2 * k + 3, *range(k + 3, 2 * k + 3)], k + 2

    def at(r: float) -> tuple[float, np.ndarray, np.ndarray]:
        t = np.zeros((k + 2, len(m)))
        for i, (a, b) in enumerate(zip([Y, *X], [WY, *WX])):
            t[i, a] += 1
            t[i, b] -= r
        f = t @ m @ t.T
        return f[0, 0], f[1:, 0], f[1:, 1:]

    rho = _golden(lambda r: _likelihood(*at(r), n, traces, r)[0], -0.99, 0.99)
    least, beta, s2 = _likelihood(*at(rho), n, traces, rho)
    got, _ = w.resolved(rho, d.select("id"), [])
    gg = got.agg(F.sum(sum((F.col(f"g_{u}") ** 2 for u in w.names), F.lit(0.0)))).first()[0] * w.scale
    tr, tr2 = _series(traces, rho)
    v = np.zeros((k + 2, k + 2))
    v[: k + 1, : k + 1] = s2 * np.linalg.inv(at(rho)[2])
    v[k + 1, k + 1] = 1 / max(tr2 + gg - 2 * tr * tr / n, 1e-10)
    return Fit(["Intercept", *x, "lambda"], np.append(beta, rho), v, n, math.inf, {"loglik": -least, "sigma2": s2, "traces": traces})
