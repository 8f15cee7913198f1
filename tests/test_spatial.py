"""Spatial regressions against dense matrices."""

import math

import numpy as np
import pytest
from abacist.operators import spatial
from pyspark.sql import functions as F


def world(n, seed=3, k=4):
    rng = np.random.default_rng(seed)
    at, x = rng.uniform(0, 1, (n, 2)), rng.normal(size=n)
    w = np.zeros((n, n))
    for i in range(n):
        d = ((at - at[i]) ** 2).sum(1)
        for j in np.argsort(d)[1 : k + 1]:
            w[i, j] = 1.0 + (i + j) % 2  # rows are standardised by the operator
    w[-1] = 0  # an island
    return at, x, w


def tables(spark, w, **cols):
    n = len(w)
    data = spark.createDataFrame([(i, *[float(c[i]) for c in cols.values()]) for i in range(n)], "id long, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    return data, spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "i long, j long, w double")


def standard(w):
    t = w.sum(1, keepdims=True)
    return w / np.where(t == 0, 1, t)


def dense(kind, w, x, y):
    """Maximum on a fine grid with exact determinants, then the information matrix."""
    n, X = len(y), np.column_stack([np.ones(len(y)), x])

    def at(r):
        A = np.eye(n) - r * w
        D = X if kind == "sar" else A @ X
        b = np.linalg.lstsq(D, A @ y, rcond=None)[0]
        e = A @ y - D @ b
        return -n / 2 * (math.log(2 * math.pi * (e @ e) / n) + 1) + np.linalg.slogdet(A)[1], b, e @ e / n, D

    r = max(np.linspace(-0.9, 0.9, 3601), key=lambda r: at(r)[0])
    ll, b, s2, D = at(r)
    G = w @ np.linalg.inv(np.eye(n) - r * w)
    if kind == "sem":
        tr = np.trace(G)
        return r, b, ll, np.append(np.sqrt(np.diag(s2 * np.linalg.inv(D.T @ D))), 1 / math.sqrt(np.trace(G @ G) + np.trace(G.T @ G) - 2 * tr * tr / n))
    g = G @ X @ b
    info = np.zeros((4, 4))
    info[:2, :2], info[:2, 2] = X.T @ X / s2, X.T @ g / s2
    info[2, :2] = info[:2, 2]
    info[2, 2] = np.trace(G @ G) + np.trace(G.T @ G) + g @ g / s2
    info[2, 3] = info[3, 2] = np.trace(G) / s2
    info[3, 3] = n / 2 / s2**2
    return r, b, ll, np.sqrt(np.diag(np.linalg.inv(info)))[:3]


@pytest.mark.parametrize("kind", ["sar", "sem"])
def test_against_dense_determinant(spark, kind):
    at, x, w = world(25)
    v = standard(w)
    rng = np.random.default_rng(5)
    A = np.linalg.inv(np.eye(25) - 0.4 * v)
    y = A @ (1 + 2 * x + rng.normal(0, 0.7, 25)) if kind == "sar" else 1 + 2 * x + A @ rng.normal(0, 0.7, 25)
    data, weights = tables(spark, w, y=y, x=x)
    r, b, ll, se = dense(kind, v, x, y)
    fit = getattr(spatial, kind)(data, weights, "y", ["x"], id_col="id")
    assert np.allclose(fit.beta, [*b, r], atol=1e-3) and math.isclose(fit.extra["loglik"], ll, abs_tol=1e-4)
    assert np.allclose(fit.se, se, rtol=2e-3)
    exact = [np.trace(np.linalg.matrix_power(v, m)) for m in range(1, spatial.ORDER + 1)]
    assert np.allclose(fit.extra["traces"], exact, atol=1e-9)


def test_hashed_probes_come_near_the_traces(spark, monkeypatch):
    monkeypatch.setattr(spatial, "ORDER", 8)
    monkeypatch.setattr(spatial, "TOGETHER", 3)
    _, x, w = world(120)
    data, weights = tables(spark, standard(w), x=x)
    got = spatial.Powers(weights, data.select("id")).traces()
    exact = [np.trace(np.linalg.matrix_power(standard(w), m)) for m in range(1, 9)]
    assert np.allclose(got[:2], exact[:2]) and np.abs(got - exact).max() < 4


def local(at, x, y, k):
    """Regressions one by one: coefficients, errors, figures."""
    n, X, rows, S, C = len(y), np.column_stack([np.ones(len(y)), x]), [], np.zeros((len(y),) * 2), []
    weights = []
    for i in range(n):
        d = np.sqrt(((at - at[i]) ** 2).sum(1))
        near = np.argsort(d)[:k]
        w = np.zeros(n)
        w[near] = np.maximum(1 - (d[near] / d[near].max()) ** 2, 0) ** 2
        c = np.linalg.inv(X.T @ (X * w[:, None])) @ (X * w[:, None]).T
        S[i] = X[i] @ c
        C.append((c**2).sum(1))
        rows.append(c @ y)
        weights.append(w)
    e = y - S @ y
    s2 = e @ e / (n - 2 * np.trace(S) + (S**2).sum())
    r2 = [1 - (w * e**2).sum() / (w * (y - w @ y / w.sum()) ** 2).sum() for w in weights]
    t = np.trace(S)
    aicc = n * math.log(e @ e / n) + n * math.log(2 * math.pi) + n * (n + t) / (n - t - 2)
    return np.array(rows), np.sqrt(s2 * np.array(C)), np.array(r2), t, aicc


def test_local_regressions(spark):
    rng = np.random.default_rng(0)
    at, x = rng.uniform(0, 10, (70, 2)), rng.normal(size=70)
    y = 1 + (0.5 + 0.1 * at[:, 1]) * x + rng.normal(0, 0.3, 70)
    data, _ = tables(spark, np.zeros((70, 70)), y=y, x=x, u=at[:, 0], v=at[:, 1])
    b, se, r2, trace, aicc = local(at, x, y, 25)
    table, figures = spatial.gwr(data, "y", ["x"], ["u", "v"], 25, id_col="id")
    got = sorted((r.asDict() for r in table.collect()), key=lambda r: r["id"])
    assert np.allclose([[r["b_Intercept"], r["b_x"]] for r in got], b) and np.allclose([[r["se_Intercept"], r["se_x"]] for r in got], se)
    assert np.allclose([r["local_r2"] for r in got], r2) and math.isclose(figures["trace"], trace) and math.isclose(figures["aicc"], aicc)
    best, score = spatial.gwr_bandwidth(data, "y", ["x"], ["u", "v"], id_col="id", least=20, most=32)
    assert math.isclose(score, local(at, x, y, best)[4]) and 20 <= best <= 32 and score <= local(at, x, y, 20)[4] and score <= local(at, x, y, 32)[4]


def test_powers_send_no_vector_through_the_driver(spark):
    """A broadcast of each power's vectors would pass the driver 24 times and more."""
    nodes = spark.range(100).select("id")
    w = spatial.Powers(nodes.select(F.col("id").alias("i"), ((F.col("id") + 1) % 100).alias("j"), F.lit(1.0).alias("w")), nodes)
    plan = w.lag(w.start, w.names)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
