"""Distribution regressions against a fit per cut, and the decomposition against cell shares."""

import numpy as np
import pytest
from abacist.operators import distreg
from abacist.operators.core import DataInsufficient


def data(n=600, seed=3):
    rng = np.random.default_rng(seed)
    g, x = rng.integers(0, 2, n), rng.normal(size=n)
    z = (rng.random(n) < 0.4 + 0.2 * g).astype(float)
    return g, np.column_stack([x, z]), np.round(1 + 0.5 * g + x * (1 + z) + rng.logistic(size=n), 1)


def logit(s, X):
    X, b = np.column_stack([np.ones(len(X)), X]), np.zeros(X.shape[1] + 1)
    b[0] = np.log(s.mean() / (1 - s.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ b))
        b = b + np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X, X.T @ (s - p))
    return b


def frame(spark, g, X, y):
    rows = [(int(a), *map(float, r), float(v)) for a, r, v in zip(g, X, y)]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0), (0, 1.0, 1.0, float("nan"))], "g int, x double, z double, y double").repartition(4)


def test_equals_a_fit_per_cut(spark):
    g, X, y = data()
    cuts = [-1.0, 0.5, 1.0, 3.0]
    fits = distreg.distribution_regression(frame(spark, g, X, y), "y", ["x", "z"], cuts, "g")
    for v in (0, 1):
        for j, c in enumerate(cuts):
            assert np.allclose(fits[v][j], logit((y[g == v] <= c).astype(float), X[g == v]), rtol=1e-6, atol=1e-8)


def test_decomposition(spark):
    g, X, y = data()
    df = frame(spark, g, X, y)
    cuts = distreg.cuts_of(df.where("g is not null and x is not null"), "y", 15)
    assert np.allclose(cuts, sorted(set(np.quantile(y, np.linspace(0.02, 0.98, 15)))))
    cuts = cuts[2:-2]  # plain Newton steps need no damping there
    for ref in (0, 1):
        f = {(a, b): np.maximum.accumulate([np.mean(1 / (1 + np.exp(-(np.column_stack([np.ones((g == b).sum()), X[g == b]]) @ logit((y[g == a] <= c).astype(float), X[g == a]))))) for c in cuts]) for a, b in ((0, 0), (1, 1), (ref, 1 - ref))}
        got = {r.tau: r for r in distreg.cfm(df, "y", ["x", "z"], "g", [0.25, 0.5, 0.8], ref, cuts=cuts).collect()}
        for t, r in got.items():
            q0, q1, qc = (np.interp(t, f[k] + 1e-9 * np.arange(len(cuts)), cuts) for k in ((0, 0), (1, 1), (ref, 1 - ref)))
            assert np.allclose([r.q_0, r.q_1, r.q_counterfactual, r.gap], [q0, q1, qc, q0 - q1], rtol=1e-6)
            assert r.composition == pytest.approx(q0 - qc if ref == 0 else qc - q1, rel=1e-5) and r.composition + r.structure == pytest.approx(r.gap)


def test_separated_and_constant_cuts(spark):
    """A covariate that splits a cut perfectly gives the observed shares; a cut outside the values gives the bounded share."""
    rows = [(0, float(z), float(v + 10 * z)) for z in (0, 1) for v in range(8)]
    df = spark.createDataFrame(rows, "g int, z double, y double")
    b = distreg.distribution_regression(df, "y", ["z"], [8.5, 100.0])[0]
    p = 1 / (1 + np.exp(-np.array([b[0] @ [1, 0], b[0] @ [1, 1]])))
    assert np.allclose(p, [1, 0], atol=1e-5) and 1 / (1 + np.exp(-b[1, 0])) == pytest.approx(0.999) and b[1, 1] == 0


def test_refusals(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0)] * 30, "g int, x double, y double")
    with pytest.raises(DataInsufficient):
        distreg.cfm(df.where("g = 5"), "y", ["x"], "g")
    with pytest.raises(DataInsufficient, match="both"):
        distreg.counterfactual(df, "y", ["x"], "g", [0.5, 2.0])
    with pytest.raises(ValueError, match="at most"):
        distreg.distribution_regression(df, "y", ["x"], [0.0] * 501)
