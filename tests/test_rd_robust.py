"""Plug-in bandwidths and bias-corrected inference against dense matrices over all rows."""

import math

import numpy as np
import pytest
from abacist.operators import rd_robust as R


def near_residuals(x, y, k=3):
    """Rows in order of x: own value's rows first, then the nearer neighbouring value, both if equally near."""
    values = sorted(set(x.tolist()))
    out = np.zeros(len(x))
    for v in values:
        at = values.index(v)
        lo = hi = at
        while sum(np.isin(x, values[lo : hi + 1])) - 1 < min(k, len(x) - 1):
            dl = v - values[lo - 1] if lo > 0 else math.inf
            dr = values[hi + 1] - v if hi + 1 < len(values) else math.inf
            lo, hi = lo - (dl <= dr), hi + (dr <= dl)
        met = np.isin(x, values[lo : hi + 1])
        j = met.sum() - 1
        for i in np.flatnonzero(x == v):
            out[i] = math.sqrt(j / (j + 1)) * (y[i] - (y[met].sum() - y[i]) / j)
    return out


def weight(u, kern):
    return np.where(np.abs(u) <= 1, {"triangular": 1 - np.abs(u), "uniform": 0.5 + 0 * u, "epanechnikov": 0.75 * (1 - u * u)}[kern], 0)


def power(x, o):
    return np.vander(x, o + 1, increasing=True)


def window(x, y, h, o, kern):
    w = weight(x / h, kern) / h
    keep = w > 0
    x, y, w = x[keep], y[keep], w[keep]
    r = power(x, o)
    return x, y, w, r, np.linalg.inv(r.T @ (r * w[:, None]))


def parts(x, y, o, nu, ob, hv, hb, scale, kern):
    xv, yv, w, r, g = window(x, y, hv, o, kern)
    s = r * (w * near_residuals(xv, yv))[:, None]
    v = (g @ s.T @ s @ g)[nu, nu]
    const = (hv ** np.arange(o + 1) * (g @ (r * w[:, None]).T @ (xv / hv) ** (o + 1)))[nu]
    xb, yb, wb, rb, gb = window(x, y, hb, ob, kern)
    beta = gb @ (rb * wb[:, None]).T @ yb
    sb = rb * (wb * near_residuals(xb, yb))[:, None]
    reg = 3 * const**2 * (gb @ sb.T @ sb @ gb)[o + 1, o + 1] if scale else 0
    c = 2 * (o + 1 - nu)
    return (2 * nu + 1) * hv ** (2 * nu + 1) * v, math.sqrt(c) * const * beta[o + 1], scale * c * reg


def cascade(x, y, form, p, deriv, kern):
    q, n = p + 1, len(x)
    lower = lambda a: np.sort(x)[math.floor((n - 1) * a)]
    side = {0: x < 0, 1: x >= 0}
    distinct = {s: len(set(x[m].tolist())) for s, m in side.items()}
    start = R.REFERENCE[kern] * min(np.std(x, ddof=1), (lower(0.75) - lower(0.25)) / 1.349) * sum(distinct.values()) ** -0.2
    wide = {0: abs(x.min()), 1: abs(x.max())}
    least = {0: 0.0, 1: 0.0}
    if any(1 - distinct[s] / side[s].sum() >= 0.2 for s in (0, 1)):
        least = {s: sorted(set(np.abs(x[m]).tolist()))[min(10, distinct[s]) - 1] + 1e-8 for s, m in side.items()}
    start = max(min(start, max(wide.values())), *least.values())

    def stage(o, nu, ob, hb, scale):
        own = {s: parts(x[side[s]], y[side[s]], o, nu, ob, start, hb[s], scale, kern) for s in (0, 1)}
        rate = 1 / (2 * o + 3)
        if form == "two":
            return {s: max(min((v / (b * b + r)) ** rate, wide[s]), least[s]) for s, (v, b, r) in own.items()}
        bias = own[1][1] + own[0][1] if form == "sum" else own[1][1] - own[0][1]
        h = max(min(((own[0][0] + own[1][0]) / (bias**2 + own[0][2] + own[1][2])) ** rate, max(wide.values())), *least.values())
        return {0: h, 1: h}

    d = stage(q + 1, q + 1, q + 2, wide, 0)
    b = stage(q, p + 1, q + 1, d, 1)
    return stage(p, deriv, q, b, 1), b


def corrected(x, y, h, b, p, deriv, kern):
    out = []
    for s, m in ((0, x < 0), (1, x >= 0)):
        xs, ys = x[m], y[m]
        wh, wb = weight(xs / h[s], kern) / h[s], weight(xs / b[s], kern) / b[s]
        keep = (wh > 0) | (wb > 0)
        xs, ys, wh, wb = xs[keep], ys[keep], wh[keep], wb[keep]
        rp, rq = power(xs, p), power(xs, p + 1)
        gp, gq = np.linalg.inv(rp.T @ (rp * wh[:, None])), np.linalg.inv(rq.T @ (rq * wb[:, None]))
        L = (rp * wh[:, None]).T @ (xs / h[s]) ** (p + 1)
        Q = (rp * wh[:, None]).T - h[s] ** (p + 1) * np.outer(L, (gq @ rq.T)[p + 1] * wb)
        e = near_residuals(xs, ys)
        v = [gp @ (a * e) @ (a * e).T @ gp for a in ((rp * wh[:, None]).T, Q)]
        out.append([(gp @ (rp * wh[:, None]).T @ ys)[deriv], (gp @ Q @ ys)[deriv], v[0][deriv, deriv], v[1][deriv, deriv]])
    f = math.factorial(deriv)
    return f * (out[1][0] - out[0][0]), f * math.sqrt(out[0][2] + out[1][2]), f * (out[1][1] - out[0][1]), f * math.sqrt(out[0][3] + out[1][3])


def data(seed, tied, n=260):
    rng = np.random.default_rng(seed)
    x = rng.normal(0.2, 1, n)
    x = np.round(x, 1) if tied else x
    return x, np.sin(2 * x) + 0.7 * (x >= 0) + 0.3 * x * (x >= 0) + rng.normal(0, 0.3, n)


@pytest.mark.parametrize("tied, kern, p, deriv", [(False, "triangular", 1, 0), (True, "epanechnikov", 1, 0), (False, "uniform", 2, 1)])
def test_against_dense_matrices(spark, tied, kern, p, deriv):
    x, y = data(3, tied)
    df = spark.createDataFrame([(float(a) + 5, float(b)) for a, b in zip(x, y)], "x double, y double").repartition(3)
    x = np.array([a + 5 - 5 for a in (x + 0.0)])
    want = {form: cascade(x, y, form, p, deriv, kern) for form in ("diff", "two", "sum")}
    t = R.value_table(df, "y", "x", 5.0)
    for select, form in (("mserd", "diff"), ("msetwo", "two"), ("cersum", "sum")):
        got = R.bandwidths(df, "y", "x", 5.0, select=select, p=p, deriv=deriv, kern=kern, table=t)
        h, b = want[form]
        shrink = len(x) ** (-p / ((3 + p) * (3 + 2 * p))) if select[:3] == "cer" else 1
        assert np.allclose([got["h_left"], got["h_right"], got["b_left"], got["b_right"]], [h[0] * shrink, h[1] * shrink, b[0], b[1]], rtol=1e-6), (select, got, h, b)
    h, b = want["diff"]
    fit = R.robust(df, "y", "x", 5.0, h=(h[0], h[1]), b=(b[0], b[1]), p=p, deriv=deriv, kern=kern)
    assert np.allclose([fit[c] for c in ("conventional", "conventional_se", "bias_corrected", "robust_se")], corrected(x, y, h, b, p, deriv, kern), rtol=1e-6)


def test_jump_is_recovered(spark):
    x, y = data(7, False, 3000)
    fit = R.robust(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"), "y", "x")
    assert fit["ci_low"] < 0.7 < fit["ci_high"] and fit["robust_se"] > fit["conventional_se"] > 0
    assert fit["n_left"] + fit["n_right"] < 3000


def test_one_side_is_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    with pytest.raises(ValueError, match="both sides"):
        R.bandwidths(df, "y", "x")


def test_selectors_share_their_passes(spark, monkeypatch):
    """cerrd shrinks what mserd found: no further pass over the table."""
    from pyspark.sql import functions as F

    passes, plain = [], R._powers
    monkeypatch.setattr(R, "_powers", lambda *a: passes.append(1) or plain(*a))
    d = spark.range(400).select((F.col("id") / 200 - 1).alias("x"), F.sin(F.col("id")).alias("y"))
    table, held = R.value_table(d, "y", "x", 0.0), {}
    first = R.bandwidths(table, "y", "x", table=table, held=held)
    before = len(passes)
    second = R.bandwidths(table, "y", "x", select="cerrd", table=table, held=held)
    assert len(passes) == before == 6 and second["b_left"] == first["b_left"] and second["h_left"] < first["h_left"]
