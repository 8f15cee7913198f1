"""Absorbed effects against dummy variables, by columns and by conjugate gradients."""

import math
import random

import numpy as np
import pytest
from abacist.operators import absorb, panel, regression
from abacist.operators.core import DataInsufficient


def rows_of(seed, n=400):
    rng = random.Random(seed)
    a, b = {i: rng.gauss(0, 0.5) for i in range(40)}, {i: rng.gauss(0, 0.5) for i in range(6)}
    out = []
    for _ in range(n):
        i, j, x, z = rng.randrange(40), rng.randrange(6), rng.gauss(0, 1), rng.gauss(2, 1)
        mean = math.exp(0.3 * x - 0.2 * z + a[i] + b[j])
        y = np.random.default_rng(rng.randrange(1 << 30)).poisson(mean)
        out.append((f"i{i}", j, x, z, float(y), rng.uniform(0.5, 2)))
    return out


def dummies(*effects):
    cols = []
    for k, e in enumerate(effects):
        levels = sorted(set(e))
        cols += [[float(v == l) for v in e] for l in levels[k > 0 :]]
    return np.array(cols).T


def poisson(y, x, e, w):
    """Newton steps with a dummy for every level: (slopes, fitted means, slopes' share of the inverse information)."""
    m = np.column_stack([x, e])
    b = np.zeros(m.shape[1])
    eta = np.log((y + y.mean()) / 2)
    for _ in range(60):
        mu = np.exp(eta)
        b = np.linalg.solve(m.T @ (m * (w * mu)[:, None]), m.T @ (w * mu * (eta + (y - mu) / mu)))
        eta = m @ b
    mu = np.exp(eta)
    return b[: x.shape[1]], mu, np.linalg.inv(m.T @ (m * (w * mu)[:, None]))[: x.shape[1], : x.shape[1]], m


@pytest.fixture(params=["columns", "gradients"])
def way(request, monkeypatch):
    if request.param == "gradients":
        monkeypatch.setattr(absorb, "SHORT", 0)
    return request.param


def kept_rows(rows):
    """Rows left when singletons are gone, then levels without any count."""
    for bad in (lambda own: len(own) == 1, lambda own: not any(r[4] for r in own)):
        while True:
            gone = {(k, v) for k in (0, 1) for v in {r[k] for r in rows} if bad([r for r in rows if r[k] == v])}
            if not gone:
                break
            rows = [r for r in rows if not any((k, r[k]) in gone for k in (0, 1))]
    return rows


def test_poisson_equals_dummies(spark, way):
    rows = rows_of(4, 400 if way == "columns" else 150)
    # a singleton, a level of zeros that leaves another level with zeros only, and a null
    more = [("alone", 0, 0.1, 0.2, 3.0, 1.0)] + [("zero", 9, 0.1 * k, 0.5, 0.0, 1.0) for k in range(3)] + [("i0", 9, 0.3, 0.4, 0.0, 1.0), ("i1", 9, 0.3, 0.4, 0.0, 1.0)]
    df = spark.createDataFrame([*rows, *more, ("i1", 2, None, 0.1, 1.0, 1.0)], "i string, j int, x double, z double, y double, w double").repartition(3)
    own = kept_rows([*rows, *more])
    i, j, x, z, y, w = (np.array(c) for c in zip(*own))
    for weights, v in ((None, np.ones(len(y))), ("w", w))[way == "gradients" :]:
        b, mu, bread, _ = poisson(y, np.column_stack([x, z]), dummies(i.tolist(), j.tolist()), v)
        fit = absorb.fepois(df, "y", ["x", "z"], ["i", "j"], weights=weights)
        levels = [len(set(i)), len(set(j))]
        free = len(y) - 2 - sum(n - 1 for n in levels)
        assert fit.n == len(y) and fit.extra["levels"] == levels
        assert fit.extra["singletons"] + fit.extra["separated"] == len(rows) + len(more) - len(own) > 1 < fit.extra["separated"]
        assert np.allclose(fit.beta, b, rtol=1e-6) and np.allclose(fit.vcov, bread * len(y) / free, rtol=1e-5)
        term = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu)
        assert math.isclose(fit.extra["deviance"], 2 * (v * term).sum(), rel_tol=1e-7)


def test_poisson_robust_and_clustered(spark):
    rows = kept_rows(rows_of(5))
    i, j, x, z, y, _ = (np.array(c) for c in zip(*rows))
    df = spark.createDataFrame(rows, "i string, j int, x double, z double, y double, w double")
    X, E = np.column_stack([x, z]), dummies(i.tolist(), j.tolist())
    b, mu, bread, _ = poisson(y, X, E, np.ones(len(y)))
    left = X - E @ np.linalg.lstsq(E * np.sqrt(mu)[:, None], X * np.sqrt(mu)[:, None], rcond=None)[0]
    s = left * (y - mu)[:, None]
    free = len(y) - 2 - (len(set(i)) - 1) - (len(set(j)) - 1)
    assert np.allclose(absorb.fepois(df, "y", ["x", "z"], ["i", "j"], vcov="HC1").vcov, bread @ s.T @ s @ bread * len(y) / free, rtol=1e-5)
    g = np.array([s[i == v].sum(0) for v in sorted(set(i))])
    expected = bread @ g.T @ g @ bread * len(g) / (len(g) - 1) * (len(y) - 1) / free
    assert np.allclose(absorb.fepois(df, "y", ["x", "z"], ["i", "j"], cluster="i").vcov, expected, rtol=1e-5)


def test_poisson_refuses(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, -0.5), (1, 3.0, 1.0), (1, 1.0, 2.0)], "i int, x double, y double")
    with pytest.raises(DataInsufficient, match="below zero"):  # level 0 sums to 0.5
        absorb.fepois(df, "y", ["x"], ["i"])
    with pytest.raises(DataInsufficient, match="no usable rows"):
        absorb.fepois(df.where("false"), "y", ["x"], ["i"])


def test_least_squares_equals_dummies(spark, way):
    """Two and three effects, with weights; the levels fall into unconnected parts."""
    rng = random.Random(9)
    rows = [(f"i{k % 30}", (k * 7) % 5 + 5 * (k % 30 // 15), f"c{(k * 11) % 3}", rng.gauss(0, 1), rng.gauss(5, 2), rng.uniform(0.5, 2)) for k in range(300)]
    df = spark.createDataFrame(rows, "i string, j int, c string, x double, y double, w double").repartition(3)
    i, j, c, x, y, w = zip(*rows)
    x, y, w = map(np.array, (x, y, w))
    for effects, e, v in ((["i", "j"], (i, j), None), (["i", "j", "c"], (i, j, c), "w")):
        E, s = dummies(*e), np.sqrt(w if v else np.ones(len(y)))[:, None]
        rx, ry = (q - E @ np.linalg.lstsq(E * s, q * s[:, 0], rcond=None)[0] for q in (x, y))
        p = s[:, 0] ** 2
        fit = panel.feols(df, "y", ["x"], effects, weights=v)
        assert math.isclose(fit["x"], (p * rx * ry).sum() / (p * rx * rx).sum(), rel_tol=1e-7)
        got = sorted(r.x for r in panel.demean(df, ["x"], effects, v).select("x").collect())
        assert np.allclose(got, np.sort(rx), atol=1e-7)


def test_long_chain_converges(spark, way):
    """Effects that hang together by a chain only: group means vanish to the last digit."""
    rows = [(k // 2, (k + 1) // 2, float(k % 7) + k, 1.0) for k in range(80)]
    df = spark.createDataFrame(rows, "i int, j int, x double, w double")
    got = panel.demean(df, ["x"], ["i", "j"]).toPandas()
    assert got.groupby("i").x.mean().abs().max() < 1e-6 and got.groupby("j").x.mean().abs().max() < 1e-6


def test_no_convergence_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(absorb, "SHORT", 0)
    monkeypatch.setattr(absorb, "STEPS", 1)
    df = spark.createDataFrame([(k // 2, (k + 1) // 2, float(k % 7)) for k in range(30)], "i int, j int, x double")
    with pytest.raises(DataInsufficient, match="did not converge"):
        panel.demean(df, ["x"], ["i", "j"])


def test_formula(spark):
    rows = rows_of(6)
    df = spark.createDataFrame(rows, "i string, j int, x double, z double, y double, w double")
    assert np.allclose(regression.regress("y ~ x + z | i + j", df, family="poisson").beta, absorb.fepois(df, "y", ["x", "z"], ["i", "j"]).beta)
