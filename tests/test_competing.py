"""Competing risks against explicit risk sets."""

import numpy as np
import pytest
from abacist.operators import competing
from abacist.operators.core import DataInsufficient


def data(n, seed):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    a, b, c = rng.exponential(np.exp(-0.6 * x)), rng.exponential(np.exp(0.4 * z) + 0.3), rng.exponential(1.5, n)
    t = np.ceil(10 * np.minimum(np.minimum(a, b), c)) / 10  # many ties
    e = np.where((a <= b) & (a <= c), 1, np.where(b <= c, 2, 0))
    return t, e, np.column_stack([x, z])


def before(t, e):
    """Share not censored just before each row's time."""
    out = {}
    for s in sorted(set(t.tolist())):
        g = 1.0
        for u in sorted(set(t[t < s].tolist())):
            g *= 1 - ((t == u) & (e == 0)).sum() / (t >= u).sum()
        out[s] = g
    return out


def by_sets(t, e, X):
    g, b = before(t, e), np.zeros(X.shape[1])
    for _ in range(30):
        u, info, ll = np.zeros(len(b)), np.zeros((len(b),) * 2), 0.0
        r = np.exp(X @ b)
        for i in np.flatnonzero(e == 1):
            w = np.where(t >= t[i], 1.0, np.where(e == 2, [g[t[i]] / g[v] for v in t], 0.0)) * r
            m = w @ X / w.sum()
            u += X[i] - m
            info += (X * w[:, None]).T @ X / w.sum() - np.outer(m, m)
            ll += X[i] @ b - np.log(w.sum())
        b = b + np.linalg.solve(info, u)
    return b, np.linalg.inv(info), ll


@pytest.mark.parametrize("n, seed", [(150, 1), (90, 7)])
def test_subdistribution_model(spark, n, seed):
    t, e, X = data(n, seed)
    df = spark.createDataFrame([(float(a), int(c), *map(float, r)) for a, c, r in zip(t, e, X)] + [(None, 1, 0.0, 0.0), (1.0, 2, None, 1.0)], "t double, e int, x double, z double").repartition(3)
    fit, (b, v, ll) = competing.finegray(df, "t", "e", ["x", "z"]), by_sets(t, e, X)
    assert np.allclose(fit.beta, b, rtol=1e-6) and np.allclose(fit.vcov, v, rtol=1e-5) and fit.n == n and fit.extra["events"] == (e == 1).sum()


def test_without_competing_events_it_is_the_plain_model(spark):
    from abacist.operators import survival

    t, e, X = data(100, 5)
    df = spark.createDataFrame([(float(a), int(c == 1), float(r[0])) for a, c, r in zip(t, e, X)], "t double, e int, x double")
    assert np.allclose(competing.finegray(df, "t", "e", ["x"]).beta, survival.cox(df, "t", "e", ["x"], ties="breslow").beta, rtol=1e-6)
    with pytest.raises(DataInsufficient, match="no event"):
        competing.finegray(df.where("e = 0"), "t", "e", ["x"])
