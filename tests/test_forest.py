"""Trees against a recursive search over rows; forests, calibration and ranked effects against their sums."""

import numpy as np
import pytest
from abacist.operators import forest
from abacist.operators.core import DataInsufficient
from pyspark.sql import functions as F


def data(n=400, seed=1):
    rng = np.random.default_rng(seed)
    X = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 5, n), rng.normal(size=n).round(1)])
    t = (rng.random(n) < 0.4).astype(float)
    y = 2 * (X[:, 0] > 4) * t + X[:, 1] + 3 * (X[:, 2] > 0.3) * (X[:, 0] < 3) + rng.normal(size=n)
    return X, t, y


def frame(spark, X, t, y):
    rows = [(i, *map(float, x), float(a), float(v), 1.0) for i, (x, a, v) in enumerate(zip(X, t, y))]
    return spark.createDataFrame([*rows, (-1, None, 1.0, 1.0, 1.0, 1.0, 1.0), (-2, 1.0, 1.0, float("nan"), 1.0, 1.0, 1.0)], "k int, a double, b double, c double, t double, y double, one double").repartition(5)


def search(num, den, X, cuts, depth, least, node=1):
    """{node: (feature, cut)} by trying every cut on the rows themselves."""
    best = None
    if depth:
        for f, cs in enumerate(cuts):
            for c in cs:
                left = X[:, f] <= c
                if min(left.sum(), (~left).sum()) < least:
                    continue
                gain = num[left].sum() ** 2 / den[left].sum() + num[~left].sum() ** 2 / den[~left].sum() - num.sum() ** 2 / den.sum()
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, c, left
    if best is None:
        return {}
    _, f, c, left = best
    return {node: (f, c), **search(num[left], den[left], X[left], cuts, depth - 1, least, 2 * node), **search(num[~left], den[~left], X[~left], cuts, depth - 1, least, 2 * node + 1)}


def splits(f, tree=0):
    return {n + 1: (int(f.feature[tree, n]), float(f.cut[tree, n])) for n in np.flatnonzero(f.feature[tree] >= 0)}


CUTS = [[float(v) for v in range(8)], [0.0, 1.0, 2.0, 3.0], [-1.0, -0.5, 0.0, 0.3, 0.8, 1.5]]


@pytest.mark.parametrize("causal", [False, True])
def test_splits_equal_a_search(spark, causal):
    X, t, y = data()
    num, den = (y * (t - 0.4), (t - 0.4) ** 2) if causal else (y, np.ones(len(y)))
    df = frame(spark, X, t, y).withColumns({"u": F.col("y") * (F.col("t") - 0.4), "v": (F.col("t") - 0.4) ** 2})
    f = forest.grow(df, *(("u", "v") if causal else ("y", "one")), ["a", "b", "c"], depth=4, least=15, cuts=CUTS)
    want = search(num, den, X, CUTS, 4, 15)
    assert splits(f) == want and len(want) > 6
    leaf = {r.k: r.l for r in df.dropna(subset=["a"]).where("k >= 0").select("k", f.leaves({c: F.col(c) for c in "abc"})[0].alias("l")).collect()}
    for n in set(leaf.values()):
        rows = [k for k, v in leaf.items() if v == n]
        assert n not in want and f.num[0, n - 1] / f.den[0, n - 1] == pytest.approx(num[rows].sum() / den[rows].sum())


def test_halves_and_rows_not_drawn(spark):
    X, t, y = data(300)
    df = frame(spark, X, t, y).where("k >= 0")
    f = forest.grow(df, "y", "one", ["a", "b", "c"], trees=3, depth=2, least=5, key="k", share=0.6, honest=True, seed=4, cuts=CUTS)
    uses = df.select("k", *[forest._drawn(4, i, F.col("k"), 0.6).alias(f"d{i}") for i in range(3)], *[(forest.uniform(4, F.lit("half"), F.lit(i), F.col("k")) < 0.5).alias(f"h{i}") for i in range(3)], f.leaves({c: F.col(c) for c in "abc"}).alias("l"))
    uses = uses.withColumn("p", f.predict(F.col("l"), F.col("k"))).collect()
    for i in range(3):
        grows = np.array([r.k for r in uses if r[f"d{i}"] and r[f"h{i}"]])
        assert splits(f, i) == search(y[grows], np.ones(len(grows)), X[grows], CUTS, 2, 5)
        for n in {r.l[i] for r in uses}:
            rest = [r.k for r in uses if r[f"d{i}"] and not r[f"h{i}"] and r.l[i] == n]
            assert f.num[i, n - 1] == pytest.approx(y[rest].mean() if rest else 0.0)
    for r in uses:
        free = [i for i in range(3) if not r[f"d{i}"]] or [0, 1, 2]
        assert r.p == pytest.approx(sum(f.num[i, r.l[i] - 1] for i in free) / sum(f.den[i, r.l[i] - 1] for i in free))


def test_drawn_features_and_refusals(spark):
    X, t, y = data(200)
    df = frame(spark, X, t, y)
    f = forest.grow(df, "y", "one", ["a", "b", "c"], trees=12, depth=1, least=5, features=1, cuts=CUTS)
    assert set(f.feature[:, 0]) == {0, 1, 2}
    with pytest.raises(ValueError, match="key"):
        forest.grow(df, "y", "one", ["a"], share=0.5)
    with pytest.raises(ValueError, match="nodes"):
        forest.grow(df, "y", "one", ["a"], trees=1000, depth=10)
    none = forest.grow(df.where("k = 10000"), "y", "one", ["a"], depth=2, cuts=[[1.0]])
    assert (none.feature == -1).all()


def test_effects_differ_where_they_do(spark):
    X, t, y = data(1500, seed=8)
    rows, _ = forest.causal_forest(frame(spark, X, t, y), "y", "t", ["a", "b", "c"], "k", trees=10, depth=3, least=15)
    rows = rows.cache()
    got = rows.agg(F.avg(F.when(F.col("a") > 4, F.col("effect"))), F.avg(F.when(F.col("a") <= 4, F.col("effect")))).first()
    assert got[0] > 1.2 and abs(got[1]) < 0.6
    fit = forest.calibration(rows, "y", "t")
    assert fit["mean"] == pytest.approx(1, abs=0.4) and fit["departure"] > 2 * fit.stderr("departure")
    assert forest.ranked_effect(rows, "__score", "effect")["ci_low"] > 0
    rows.unpersist()


@pytest.mark.parametrize("target", ["AUTOC", "QINI"])
def test_ranked_effect(spark, target):
    rng = np.random.default_rng(5)
    p, s = rng.integers(0, 30, 200).astype(float), rng.normal(size=200) + 1
    n, at = 200, np.argsort(-p, kind="stable")
    k = np.arange(1, n + 1)
    w = np.array([sum(1 / j for j in range(i, n + 1)) - 1 for i in k]) if target == "AUTOC" else (n - k + 1) / n - (n + 1) / (2 * n)
    weight = np.empty(n)
    weight[at] = w
    weight = np.array([weight[p == v].mean() for v in p])
    phi = weight * (s - s.mean())
    df = spark.createDataFrame([*zip(p.tolist(), s.tolist()), (None, 1.0)], "p double, s double").repartition(4)
    got = forest.ranked_effect(df, "s", "p", target)
    assert got["estimate"] == pytest.approx((weight * s).mean(), rel=1e-9) and got["std_error"] == pytest.approx(np.sqrt(phi.var() / (n - 1)), rel=1e-9)
    with pytest.raises(ValueError, match="AUTOC"):
        forest.ranked_effect(df, "s", "p", "none")
    with pytest.raises(DataInsufficient):
        forest.ranked_effect(df.where("p > 100"), "s", "p", target)


@pytest.mark.parametrize("bound", [forest.MOST_CELLS, 0])
def test_rows_are_read_once_and_cells_equal_rows(spark, monkeypatch, bound):
    X, t, y = data(300)
    written, tables = forest.written, []
    monkeypatch.setattr(forest, "written", lambda df, s: tables.append(written(df, s)) or tables[-1])
    monkeypatch.setattr(forest, "MOST_CELLS", bound)
    f = forest.grow(frame(spark, X, t, y), "y", "one", ["a", "b", "c"], depth=4, least=15, cuts=CUTS)
    assert splits(f) == search(y, np.ones(len(y)), X, CUTS, 4, 15)
    # sums by bins, so that no level goes over the rows again
    assert [v.agg(F.sum("__m")).first()[0] for v in tables] == ([300] if bound else [])
