"""Data-driven bandwidths and bias-corrected inference at a cutoff.

Rows are reduced once to the distinct values of the running variable on each side: how many, and the sums
of the outcome and its square.  Beside each value stand the values before and after it, by offsets inside
quantile cells with the border values of the next cells handed over, so that nearest-neighbour residuals need
no global sort.  Each stage of the plug-in cascade, each variance and the final estimate is then one
aggregation over this table: kernel-weighted power sums, and power sums of squared residuals.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import num
from abacist.operators.core import DataInsufficient, in_cells, inverse, running, usable
from abacist.operators.panel import written

#: The reference bandwidth's constant of each kernel.
REFERENCE = {"triangular": 2.576, "uniform": 1.843, "epanechnikov": 2.34}
SELECTORS = ("mserd", "msetwo", "msesum", "msecomb1", "msecomb2", "cerrd", "certwo", "cersum", "cercomb1", "cercomb2")
NEAR = 3


def _weight(u: Column, kern: str) -> Column:
    inside = {"triangular": 1 - F.abs(u), "uniform": F.lit(0.5), "epanechnikov": 0.75 * (1 - u * u)}[kern]
    return F.when(F.abs(u) <= 1, inside).otherwise(0.0)


def value_table(df: DataFrame, y: str, running_: str, cutoff: float) -> DataFrame:
    """(side, x, n, s, q, before, after, e, far): distinct x - cutoff with count and sums of y, y squared; ``NEAR`` values on either way, nearest first.

    ``e``: the squared nearest-neighbour residuals with all of these values, ``far`` the one farthest from the cutoff; windows that hold it need no other.
    """
    d = usable(df, {"y": F.col(y), "x": num(running_) - cutoff})
    d = d.groupBy((F.col("x") >= 0).cast("int").alias("side"), "x").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    d = written(in_cells(d, "x"), df.sparkSession)
    up, down = Window.partitionBy("side", "__cell").orderBy("x"), Window.partitionBy("side", "__cell").orderBy(F.desc("x"))
    # at most six values of each cell, and a cell for each shuffle partition
    edges = d.withColumns({"__u": F.row_number().over(up), "__d": F.row_number().over(down)}).where(f"__u <= {NEAR} or __d <= {NEAR}").select("side", "__cell", "x", "n", "s").collect()
    halo = []
    for side in (0, 1):
        own = sorted((r for r in edges if r.side == side), key=lambda r: r.x)
        for c in {r["__cell"] for r in own}:
            low, high = [r for r in own if r["__cell"] < c], [r for r in own if r["__cell"] > c]
            halo += [(side, c, r.x, r.n, r.s) for r in low[-NEAR:] + high[:NEAR]]
    more = df.sparkSession.createDataFrame(halo, "side int, __cell double, x double, n double, s double").withColumns({"q": F.lit(None).cast("double"), "__own": F.lit(False)})
    both = d.withColumn("__own", F.lit(True)).unionByName(more)
    item = lambda k, w: F.when(F.lag("x", k).over(w).isNotNull(), F.struct(F.lag("x", k).over(w).alias("x"), F.lag("n", k).over(w).alias("n"), F.lag("s", k).over(w).alias("s")))
    near = both.withColumns({"before": F.array_compact(F.array(*[item(k, up) for k in range(1, NEAR + 1)])), "after": F.array_compact(F.array(*[item(k, down) for k in range(1, NEAR + 1)]))})
    near = near.where("__own").select("side", "x", "n", "s", "q", "before", "after").withColumn("__m", _met(F.col("before"), F.col("after")))
    # a row's values lie on its side of the cutoff, in order
    far = F.greatest(*[F.abs(F.element_at(F.when(F.size(c) > 0, F.col(c)), -1)["x"]) for c in ("before", "after")])
    return written(near.select("side", "x", "n", "s", "q", "before", "after", _total(F.col("__m")).alias("e"), F.coalesce(far, F.lit(0.0)).alias("far")), df.sparkSession)


def _met(left: Column, right: Column) -> Column:
    """(n, s) of a value with its nearest neighbours out of the values ``left`` and ``right``.

    Equal values belong together, and come before the values on either way, of which the nearer goes first, both if equally near.
    """
    start = F.struct(F.lit(1).alias("l"), F.lit(1).alias("r"), F.col("n").alias("n"), F.col("s").alias("s"))

    def step(a: Column, _: Column) -> Column:
        lo, hi = F.get(left, a["l"] - 1), F.get(right, a["r"] - 1)
        dl, dr = F.coalesce(F.col("x") - lo["x"], F.lit(math.inf)), F.coalesce(hi["x"] - F.col("x"), F.lit(math.inf))
        open_ = a["n"] - 1 < NEAR
        one, two = open_ & lo.isNotNull() & (dl <= dr), open_ & hi.isNotNull() & (dr <= dl)
        add = lambda f: F.when(one, lo[f]).otherwise(0.0) + F.when(two, hi[f]).otherwise(0.0)
        return F.struct((a["l"] + one.cast("int")).alias("l"), (a["r"] + two.cast("int")).alias("r"), (a["n"] + add("n")).alias("n"), (a["s"] + add("s")).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEAR)), start, step)


def _total(m: Column) -> Column:
    """Sum of squared nearest-neighbour residuals of the rows at one value."""
    j, s = m["n"] - 1, m["s"]
    total = j / (j + 1) * (((j + 1) / j) ** 2 * F.col("q") - 2 * (j + 1) / (j * j) * s * F.col("s") + F.col("n") * s * s / (j * j))
    return F.when(j > 0, F.greatest(total, F.lit(0.0))).otherwise(0.0)


def _with_squares(t: DataFrame, reach: Column) -> DataFrame:
    """``__e``: squared residuals where neighbours beyond ``reach`` of the cutoff do not exist; only values next to it need other sums than the table's."""
    left, right = (F.filter(c, lambda v: F.abs(v["x"]) < reach) for c in ("before", "after"))
    at_border = F.get(F.transform(F.array(F.struct(left.alias("l"), right.alias("r"))), lambda v: _total(_met(v["l"], v["r"]))), F.lit(0))
    return t.withColumn("__e", F.when(F.col("far") < reach, F.col("e")).otherwise(at_border))


def _by_side(h: dict[int, float]) -> Column:
    return F.when(F.col("side") == 1, F.lit(float(h[1]))).otherwise(F.lit(float(h[0])))


def _powers(t: DataFrame, h: dict[int, float], kern: str, most: int, deep: int, squares: bool) -> dict[int, dict[str, np.ndarray]]:
    """By side: sums of w u^i n (to ``most``), of w u^i y (to ``deep``), and of w^2 u^i times squared residuals."""
    reach = _by_side(h)
    u = F.col("x") / reach
    d = t.withColumns({"__w": _weight(u, kern) / reach, "__u": u}).where("__w > 0")
    if squares:
        # a uniform window holds its border
        d = _with_squares(d, reach * (1 + 1e-12) if kern == "uniform" else reach)
    p = lambda i: F.pow("__u", F.lit(i)) if i else F.lit(1.0)
    sums = [F.sum(F.col("__w") * p(i) * F.col("n")) for i in range(most + 1)] + [F.sum(F.col("__w") * p(i) * F.col("s")) for i in range(deep + 1)]
    sums += [F.sum(F.col("__w") ** 2 * p(i) * F.col("__e")) for i in range(2 * deep + 1)] if squares else []
    out = {}
    for r in d.groupBy("side").agg(F.sum("n"), *sums).collect():
        v = np.array(r[2:], dtype=float)
        out[r[0]] = {"rows": r[1], "w": v[: most + 1], "y": v[most + 1 : most + deep + 2], "e": v[most + deep + 2 :]}
    if set(out) != {0, 1}:
        raise DataInsufficient("both sides need rows within the bandwidth")
    return out


def _hankel(v: np.ndarray, k: int) -> np.ndarray:
    return np.array([[v[i + j] for j in range(k)] for i in range(k)])


def _parts(t: DataFrame, kern: str, o: int, nu: int, o_b: int, h_v: float, h_b: dict[int, float], scale: float, held: dict) -> dict[int, dict[str, float]]:
    """Variance, bias and its own variance on each side of an order-``o`` fit, the bias by an order-``o_b`` fit."""
    if ("v", o) not in held:
        held["v", o] = _powers(t, {0: h_v, 1: h_v}, kern, 2 * o + 1, o, True)
    near, wide = held["v", o], _powers(t, h_b, kern, 2 * o_b, o_b, scale > 0)
    out = {}
    for side in (0, 1):
        a, b, k, m = near[side], wide[side], o + 1, o_b + 1
        bread, bread_b = inverse(_hankel(a["w"], k)), inverse(_hankel(b["w"], m))
        v = (bread @ _hankel(a["e"], k) @ bread)[nu, nu] / h_v ** (2 * nu)
        constant = (bread @ a["w"][o + 1 : 2 * o + 2])[nu]
        slope = (bread_b @ b["y"])[o + 1] / h_b[side] ** (o + 1)
        r = 0.0
        if scale > 0:
            r = 3 * constant**2 * (bread_b @ _hankel(b["e"], m) @ bread_b)[o + 1, o + 1] / h_b[side] ** (2 * o + 2)
        c = 2 * (o + 1 - nu)
        out[side] = {"V": (2 * nu + 1) * h_v ** (2 * nu + 1) * v, "B": math.sqrt(c) * constant * slope, "R": scale * c * r}
    return out


def _start(t: DataFrame, kern: str, masspoints: bool) -> tuple[float, float, dict[int, float], dict[int, float]]:
    """(reference bandwidth, rows, the far end and the least window of each side) of a table of values."""
    by = {r[0]: r for r in t.groupBy("side").agg(F.count("*"), F.sum("n"), F.min("x"), F.max("x"), F.sum(F.col("n") * F.col("x"))).collect()}
    if set(by) != {0, 1}:
        raise DataInsufficient("both sides need rows")
    n = by[0][2] + by[1][2]
    mean = (by[0][5] + by[1][5]) / n
    sd = math.sqrt(t.agg(F.sum(F.col("n") * (F.col("x") - mean) ** 2)).first()[0] / (n - 1))
    counted = running(t.select("x", "n"), "x", {"n": F.col("n")})
    low, high = counted.agg(*[F.min(F.when(F.col("run_n") > math.floor((n - 1) * a), F.col("x"))) for a in (0.25, 0.75)]).first()
    tied = masspoints and any(1 - by[s][1] / by[s][2] >= 0.2 for s in (0, 1))
    wide = {0: abs(by[0][3]), 1: abs(by[1][4])}  # to the far end of each side
    least = {s: 0.0 for s in (0, 1)}
    if tied:
        for s in (0, 1):
            least[s] = max(r[0] for r in t.where(F.col("side") == s).select(F.abs("x")).orderBy(F.abs("x")).limit(10).collect()) + 1e-8
    start = REFERENCE[kern] * min(sd, (high - low) / 1.349) * (by[0][1] + by[1][1] if masspoints else n) ** -0.2
    return max(min(start, max(wide.values())), *least.values()), n, wide, least


def bandwidths(df: DataFrame, y: str, running_: str, cutoff: float = 0.0, *, select: str = "mserd", p: int = 1, q: int | None = None, deriv: int = 0, kern: str = "triangular", regular: float = 1.0, masspoints: bool = True, table: DataFrame | None = None, held: dict | None = None) -> dict[str, float]:
    """h and b on each side by the three-stage plug-in, with the reference bandwidth it starts from.

    ``select``: mean-square optimal for both sides in common (mserd), for each (msetwo), for the sum (msesum), their
    smallest (msecomb1) or median (msecomb2); cer... shrinks them for coverage.  With ``masspoints`` repeated values count
    once in the reference bandwidth, and if a fifth of a side repeats, ten distinct values stay inside every window.
    Calls that differ in ``select`` alone share what they find in ``held``.
    """
    if select not in SELECTORS:
        raise ValueError(f"select must be one of {SELECTORS}")
    q = p + 1 if q is None else q
    t = value_table(df, y, running_, cutoff) if table is None else table
    held = {} if held is None else held
    if "start" not in held:
        held["start"] = _start(t, kern, masspoints)
    start, n, wide, least = held["start"]

    def clamp(v: float, side: int | None) -> float:
        return max(min(v, max(wide.values()) if side is None else wide[side]), max(least.values()) if side is None else least[side])

    def joined(parts: dict, o: int, form: str) -> dict[int, float]:
        rate, (l, r) = 1 / (2 * o + 3), (parts[0], parts[1])
        if form == "two":
            return {s: clamp((x["V"] / (x["B"] ** 2 + regular * x["R"])) ** rate, s) for s, x in parts.items()}
        bias = r["B"] + l["B"] if form == "sum" else r["B"] - l["B"]
        h = clamp(((l["V"] + r["V"]) / (bias**2 + regular * (l["R"] + r["R"]))) ** rate, None)
        return {0: h, 1: h}

    def cascade(form: str) -> tuple[dict, dict]:
        if "wide" not in held:
            held["wide"] = _parts(t, kern, q + 1, q + 1, q + 2, start, wide, 0.0, held)
        if form not in held:
            d = joined(held["wide"], q + 1, form)
            b = joined(_parts(t, kern, q, p + 1, q + 1, start, d, regular, held), q, form)
            held[form] = joined(_parts(t, kern, p, deriv, q, start, b, regular, held), p, form), b
        return held[form]

    kind = select[3:]
    if kind.startswith("comb"):
        every = [cascade(f) for f in ("diff", "two", "sum")]
        pick = (lambda v: min(v)) if kind == "comb1" else (lambda v: sorted(v)[1])
        if kind == "comb1":
            h, b = ({s: min(e[i][s] for e in (every[0], every[2])) for s in (0, 1)} for i in (0, 1))
        else:
            h, b = ({s: pick([e[i][s] for e in every]) for s in (0, 1)} for i in (0, 1))
    else:
        h, b = cascade({"rd": "diff", "two": "two", "sum": "sum"}[kind])
    if select.startswith("cer"):
        h = {s: v * n ** (-p / ((3 + p) * (3 + 2 * p))) for s, v in h.items()}
    return {"reference": float(start), "h_left": float(h[0]), "h_right": float(h[1]), "b_left": float(b[0]), "b_right": float(b[1])}


def robust(df: DataFrame, y: str, running_: str, cutoff: float = 0.0, *, h: float | tuple[float, float] | None = None, b: float | tuple[float, float] | None = None, p: int = 1, q: int | None = None, deriv: int = 0, kern: str = "triangular", select: str = "mserd") -> dict[str, float]:
    """Jump (``deriv`` 0) or kink (1) at the cutoff: conventional, and bias-corrected with the robust error that counts the correction.

    Errors use nearest-neighbour residuals.  Bandwidths not given come from ``bandwidths``; ``b`` alone defaults to ``h``.
    """
    q = p + 1 if q is None else q
    t = value_table(df, y, running_, cutoff)
    pair = lambda v: tuple(v) if isinstance(v, (tuple, list)) else (v, v)
    if h is None:
        w = bandwidths(df, y, running_, cutoff, select=select, p=p, q=q, deriv=deriv, kern=kern, table=t)
        H, B = {0: w["h_left"], 1: w["h_right"]}, {0: w["b_left"], 1: w["b_right"]}
    else:
        H = dict(enumerate(pair(h)))
        B = dict(enumerate(pair(h if b is None else b)))
    at, wide = _by_side(H), _by_side(B)
    u = F.col("x") / at  # powers of one scale for both windows
    d = t.withColumns({"__u": u, "__h": _weight(u, kern) / at, "__b": _weight(F.col("x") / wide, kern) / wide}).where("__h > 0 or __b > 0")
    reach = F.greatest(at, wide)
    d = _with_squares(d, reach * (1 + 1e-12) if kern == "uniform" else reach)
    pw = lambda i: F.pow("__u", F.lit(i)) if i else F.lit(1.0)
    spec = [(c, i, v) for c, top in (("__h", 2 * p + 1), ("__b", 2 * q)) for v in ("n",) for i in range(top + 1)]
    spec += [(c, i, "s") for c, top in (("__h", p), ("__b", q)) for i in range(top + 1)]
    sums = [F.sum(F.col(c) * pw(i) * F.col(v)).alias(f"{c}{v}{i}") for c, i, v in spec]
    sums += [F.sum(F.col(a) * F.col(c) * pw(i) * F.col("__e")).alias(f"{a}{c}{i}") for a, c, top in (("__h", "__h", 2 * p), ("__h", "__b", p + q), ("__b", "__b", 2 * q)) for i in range(top + 1)]
    sums += [F.sum(F.when(F.col(c) > 0, F.col("n")).otherwise(0)).alias(f"rows{c}") for c in ("__h", "__b")]
    rows = {r.side: r for r in d.groupBy("side").agg(*sums).collect()}
    if set(rows) != {0, 1}:
        raise DataInsufficient("both sides need rows within the bandwidth")
    plain, corrected, var, var_c = {}, {}, {}, {}
    for side, r in rows.items():
        v = lambda name, top: np.array([r[f"{name}{i}"] for i in range(top + 1)])  # noqa: E731, B023
        w_h = v("__hn", 2 * p + 1)
        bread, bread_q = inverse(_hankel(w_h, p + 1)), inverse(_hankel(v("__bn", 2 * q), q + 1))
        beta, beta_q = bread @ v("__hs", p), bread_q @ v("__bs", q)
        bias = bread @ w_h[p + 1 : 2 * p + 2]  # of a unit of the next power
        ee = _hankel(v("__h__h", 2 * p), p + 1)
        hb = v("__h__b", p + q)
        cross = np.array([[hb[i + j] for j in range(q + 1)] for i in range(p + 1)]) @ bread_q[:, p + 1]
        bb = bread_q[p + 1] @ _hankel(v("__b__b", 2 * q), q + 1) @ bread_q[p + 1]
        mixed = np.outer(bread @ cross, bias)
        plain[side], corrected[side] = beta[deriv], (beta - bias * beta_q[p + 1])[deriv]
        own = bread @ ee @ bread
        var[side], var_c[side] = own[deriv, deriv], (own - mixed - mixed.T + np.outer(bias, bias) * bb)[deriv, deriv]
    scale = {s: math.factorial(deriv) / H[s] ** deriv for s in (0, 1)}
    jump, fixed = (float(e[1] * scale[1] - e[0] * scale[0]) for e in (plain, corrected))
    se, se_r = (math.sqrt(e[0] * scale[0] ** 2 + e[1] * scale[1] ** 2) for e in (var, var_c))
    z = dist.norm_ppf(0.975)
    return {
        "conventional": jump, "conventional_se": se, "bias_corrected": fixed, "robust_se": se_r, "p_value": dist.two_sided(fixed / se_r) if se_r else math.nan, "ci_low": fixed - z * se_r, "ci_high": fixed + z * se_r,
        "h_left": H[0], "h_right": H[1], "b_left": B[0], "b_right": B[1], "n_left": float(rows[0]["rows__h"]), "n_right": float(rows[1]["rows__h"]),
    }
