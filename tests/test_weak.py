"""Weak-instrument statistics against matrices over all rows, and conditional p-values against draws."""

import numpy as np
import pytest
from abacist.functions import dist
from abacist.operators import weak
from abacist.operators.core import DataInsufficient


def data(n=400, seed=2):
    rng = np.random.default_rng(seed)
    W, Z = rng.normal(size=(n, 1)), rng.normal(size=(n, 3))
    u, c = rng.normal(size=(n, 2)), rng.integers(0, 25, n)
    D = Z @ np.array([[0.3, 0.1], [0.1, 0.2], [0.0, 0.1]]) + 0.5 * W + u * (1 + 0.5 * np.abs(Z[:, :1]))
    y = D @ [1.0, -0.5] + W[:, 0] + u[:, 0] + rng.normal(size=n)
    return y, D, Z, W, c


def frame(spark, y, D, Z, W, c):
    rows = [(float(a), *map(float, d), *map(float, z), float(w[0]), int(k)) for a, d, z, w, k in zip(y, D, Z, W, c)]
    return spark.createDataFrame([*rows, (None,) * 8], "y double, d0 double, d1 double, z0 double, z1 double, z2 double, w double, c int").repartition(3)


def clear(a, W):
    X = np.column_stack([np.ones(len(W)), W])
    return a - X @ np.linalg.lstsq(X, a, rcond=None)[0]


Z3 = ["z0", "z1", "z2"]


def scores(D, Z):
    pi = np.linalg.lstsq(Z, D, rcond=None)[0]
    return pi, np.einsum("ni,nj->nij", Z, D - Z @ pi).reshape(len(Z), -1)


@pytest.mark.parametrize("how", ["robust", "cluster", "nonrobust"])
def test_one_regressor_is_a_wald_test(spark, how):
    y, D, Z, W, c = data()
    d, z = clear(D[:, :1], W), clear(Z, W)
    pi, s = scores(d, z)
    zi = np.linalg.inv(z.T @ z)
    if how == "nonrobust":
        v = zi * ((d - z @ pi) ** 2).sum() / (len(y) - 5)
    else:
        by = np.array([s[c == k].sum(axis=0) for k in np.unique(c)]) if how == "cluster" else s
        v = zi @ by.T @ by @ zi * (len(by) / (len(by) - 1) if how == "cluster" else 1)
    want = float(pi[:, 0] @ np.linalg.solve(v, pi[:, 0]))
    got = weak.kleibergen_paap(frame(spark, y, D, Z, W, c), ["d0"], Z3, ["w"], vcov="robust" if how == "cluster" else how, cluster="c" if how == "cluster" else None)
    assert got["wald"] == pytest.approx(want, rel=1e-8) and got["df"] == 3 and got["n"] == len(y) and got["f"] == pytest.approx(want / 3)
    if how == "nonrobust":
        assert got["cragg_donald"] == pytest.approx(want / 3, rel=1e-8)


def test_two_regressors(spark):
    """Without robust variances the rank statistic is the least eigenvalue; with them it does not depend on how regressors are combined."""
    y, D, Z, W, c = data()
    d, z = clear(D, W), clear(Z, W)
    pi, _ = scores(d, z)
    s = (d - z @ pi).T @ (d - z @ pi) / (len(y) - 5)
    least = np.linalg.eigvals(np.linalg.solve(s, pi.T @ z.T @ z @ pi)).real.min()
    f = frame(spark, y, D, Z, W, c)
    plain = weak.kleibergen_paap(f, ["d0", "d1"], Z3, ["w"], "nonrobust")
    assert plain["wald"] == pytest.approx(least, rel=1e-8) and plain["cragg_donald"] == pytest.approx(least / 3, rel=1e-8) and plain["df"] == 2
    a = weak.kleibergen_paap(f, ["d0", "d1"], Z3, ["w"])["wald"]
    b = weak.kleibergen_paap(f.selectExpr("d0 + 2 * d1 as a", "d0 - d1 as b", "3 * z0 as z0", "z1 + z0 as z1", "z2", "w"), ["a", "b"], Z3, ["w"])["wald"]
    assert a == pytest.approx(b, rel=1e-7)
    with pytest.raises(DataInsufficient, match="fewer"):
        weak.kleibergen_paap(f, ["d0", "d1"], ["z0"])


def test_effective_f(spark):
    y, D, Z, W, c = data()
    d, z = clear(D[:, :1], W), clear(Z, W)
    pi, s = scores(d, z)
    zi = np.linalg.inv(z.T @ z)
    q = float(pi[:, 0] @ z.T @ z @ pi[:, 0])
    got = weak.effective_f(frame(spark, y, D, Z, W, c), "d0", Z3, ["w"])
    assert got["effective_f"] == pytest.approx(q / np.trace(s.T @ s @ zi) * (len(y) - 5) / len(y), rel=1e-8)
    same = weak.effective_f(frame(spark, y, D, Z, W, c), "d0", Z3, ["w"], "classic")
    assert same["effective_f"] == pytest.approx(same["first_stage_f"]) == got["first_stage_f"]


def test_conditional_lr(spark):
    y, D, Z, W, c = data()
    f = frame(spark, y, D, Z, W, c)
    got = weak.conditional_lr(f, "y", "d0", Z3, ["w"], 0.7)
    u, z = clear(np.column_stack([y - 0.7 * D[:, 0], D[:, 0]]), W), clear(Z, W)
    P = z @ np.linalg.solve(z.T @ z, z.T)
    s = u.T @ (u - P @ u) / (len(y) - 5)
    # the ratio is the AR statistic less the least it can be over all coefficients
    grid = np.concatenate([np.linspace(-30, 30, 60_001), [0.7]])
    e = np.column_stack([np.ones(len(grid)), -(grid - 0.7)])
    ar = np.einsum("gi,ij,gj->g", e, u.T @ P @ u, e) / np.einsum("gi,ij,gj->g", e, s, e)
    assert got["anderson_rubin"] == pytest.approx(ar[-1], rel=1e-8) and got["statistic"] == pytest.approx(ar[-1] - ar.min(), rel=1e-4)
    one = weak.conditional_lr(f, "y", "d0", ["z0"], ["w"], 0.7)
    assert one["statistic"] == pytest.approx(one["anderson_rubin"]) and one["p_value"] == pytest.approx(dist.chi2_sf(one["statistic"], 1))


@pytest.mark.parametrize("k, strength, stat", [(2, 3.0, 2.5), (3, 0.5, 6.0), (5, 20.0, 4.0)])
def test_conditional_p_value(k, strength, stat):
    draws = np.random.default_rng(1).normal(size=(400_000, k)) ** 2
    ar = draws.sum(axis=1)
    lr = 0.5 * (ar - strength + np.sqrt((ar - strength) ** 2 + 4 * draws[:, 0] * strength))
    assert weak._conditional_tail(stat, strength, k) == pytest.approx((lr > stat).mean(), abs=0.003)
