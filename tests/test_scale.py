"""Forms that spread order statistics and cross-fitting hold against the plain ones."""

import math

import numpy as np
import pytest
from abacist.operators import causal, core, describe
from abacist.operators.regression import glm, ols, predicted
from pyspark.sql import Window
from pyspark.sql import functions as F


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 11 == 0 else f"g{i % 3}", None if i % 7 == 0 else math.nan if i % 13 == 0 else float(rng.integers(0, 40)), float(rng.lognormal())) for i in range(2000)]
    d = spark.createDataFrame([*rows, ("empty", None, 1.0)], "g string, v double, w double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    want = {r.g: (r.v, r.w) for r in d.groupBy("g").agg(*[F.percentile(F.when(~F.isnan(c), F.col(c)), F.array(*map(F.lit, probs))).alias(c) for c in ("v", "w")]).collect()}
    got = {r.g: (r.q_v, r.q_w) for r in core.quantiles(d, ["v", "w"], probs, ["g"]).collect()}
    assert got.keys() == want.keys() and got["empty"][0] is None
    for g in want:
        for a, b in zip(got[g], want[g]):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-12)


def test_quantiles_of_nothing(spark):
    d = spark.createDataFrame([], "g string, v double")
    assert core.quantiles(d, ["v"], [0.5]).collect() == [(None,)]
    assert core.quantiles(d, ["v"], [0.5], ["g"]).collect() == []
    assert describe.sumstats(d, ["v"]).first().n == 0


def test_winsor_keeps_every_row(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 100.0), (None, 3.0), ("b", None)], "g string, v double")
    got = {(r.g, r.v): r.v_w for r in describe.winsor(d, ["v"], 0.25, 0.75, ["g"]).collect()}
    assert got == {("a", 1.0): 25.75, ("a", 100.0): 75.25, (None, 3.0): 3.0, ("b", None): None}


def test_merged_grams(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(int(i % 4), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(1e4, 1, (200, 2)))], "f int, a double, b double")
    both, whole = core.merged(list(core.grouped_gram(d, ["a", "b"], ["f"]).values())), core.gram(d, ["a", "b"])
    assert both.rows == whole.rows
    assert np.allclose(both.mean, whole.mean, rtol=1e-12) and np.allclose(both.cross, whole.cross, rtol=1e-7)


def test_cross_fitting_equals_a_fit_per_fold(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 2)) * [1, 30] + [0, 200]
    t = (rng.random(1500) < 1 / (1 + np.exp(-x[:, 0] * 0.7))).astype(float)
    y = 2 * t + x @ [1, 0.1] + rng.normal(size=1500)
    d = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(np.column_stack([y, t, x]))], "id int, y double, t double, a double, b double")
    on, cols, folds = ["a", "b"], {c: F.col(c) for c in ("a", "b")}, 3
    parts, plr = [], []
    for f in range(folds):
        at = causal.fold_of(folds, 0, F.col("id"))
        rest, here = d.where(at != f), d.where(at == f)
        m1, m0 = (ols(rest.where(F.col("t") == v), "y", on).predict(cols) for v in (1, 0))
        e = predicted(glm(rest, "t", on, family="logit"), cols)
        parts += [tuple(r) for r in here.select("y", "t", m1, m0, F.least(F.greatest(e, F.lit(0.01)), F.lit(0.99))).collect()]
        plr += [tuple(r) for r in here.select(F.col("y") - ols(rest, "y", on).predict(cols), F.col("t") - ols(rest, "t", on).predict(cols)).collect()]
    v, t, m1, m0, e = np.array(parts).T
    psi = m1 - m0 + t * (v - m1) / e - (1 - t) * (v - m0) / (1 - e)
    got = causal.aipw(d, "y", "t", on, "id", folds)
    assert (got["estimate"], got["std_error"]) == pytest.approx((psi.mean(), psi.std(ddof=1) / math.sqrt(len(psi))), rel=1e-6)
    u, w = np.array(plr).T
    theta = (u @ w) / (w @ w)
    got = causal.dml_plr(d, "y", "t", on, "id", folds)
    assert (got["estimate"], got["std_error"]) == pytest.approx((theta, math.sqrt((w**2 * (u - theta * w) ** 2).sum()) / (w @ w)), rel=1e-8)


def test_median_imputation_keeps_every_row(spark):
    from abacist.operators import tabulate

    d = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0), (None, 2.0), (None, None), ("b", None)], "g string, v double")
    got = sorted((tuple(r) for r in tabulate.impute(d, ["v"], "median", ["g"]).collect()), key=repr)
    assert got == sorted([("a", 1.0), ("a", 2.5), ("a", 4.0), (None, 2.0), (None, 2.0), ("b", None)], key=repr)


@pytest.mark.parametrize("run", [3, 4, 100])
@pytest.mark.parametrize("kind", ["int", "date", "timestamp", "string"])
def test_lags_across_cells_and_runs(spark, run, kind):
    """Values of earlier rows equal a plain window's, over groups (one of them null) of any size."""
    of = {"int": "id", "date": "date_add(date'2020-01-01', id)", "timestamp": "timestamp_seconds(id)", "string": "lpad(id, 5, '0')"}[kind]
    d = spark.range(61).selectExpr("cast((id * 37) % 61 as int) as id").selectExpr("id", "case when id % 7 = 0 then null when id % 7 < 3 then 'a' else 'b' end as g", "cast(id * id as double) as v")
    d = d.withColumn("t", F.expr(of)).repartition(5)
    w = Window.partitionBy("g").orderBy("t")
    want = d.select("id", F.lag("v", 1).over(w), F.lag("v", 3).over(w))
    got = core.lagged(d, "t", ["v"], 3, ["g"], run=run).select("id", "v_1", "v_3")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plain = core.lagged(d, "t", ["v"], 2, run=run).select("id", "v_2").collect()
    assert {r.id: r.v_2 for r in plain} == {i: float((i - 2) ** 2) if i > 1 else None for i in range(61)}


def test_one_effect_is_absorbed_by_sums_per_level(spark, monkeypatch):
    """Rows are neither joined nor written without robust errors; all errors equal those of numpy on demeaned rows."""
    from abacist.operators import panel

    rng = np.random.default_rng(8)
    g = np.concatenate([rng.integers(0, 20, 400), [100, 101]])  # the last two are alone
    c, x = g % 7 * 10 + rng.integers(0, 2, 402), rng.normal(size=402) + 1e6
    y = 0.7 * (x - 1e6) + g + rng.normal(size=402) * (1 + (x > 1e6))
    rows = [*zip(map(int, g), map(int, c), map(float, x), map(float, y)), (None, 1, 2.0, 3.0), (1, 1, None, 3.0)]
    d = spark.createDataFrame(rows, "g int, c int, x double, y double").repartition(4)
    g, c, x, y = (v[:400] for v in (g, c, x, y))
    mx, my = (np.array([v[g == k].mean() for k in g]) for v in (x, y))
    x, y = x - mx, y - my
    b, n, levels = (x @ y) / (x @ x), 400, len(set(g))
    e = y - b * x
    by = lambda v: sum((x * e)[v == k].sum() ** 2 for k in set(v))
    many = len(set(c))
    want = {"nonrobust": e @ e / (n - levels - 1) / (x @ x), "HC1": ((x * e) ** 2).sum() / (x @ x) ** 2 * n / (n - levels - 1), "c": by(c) / (x @ x) ** 2 * many / (many - 1) * (n - 1) / (n - 1 - levels), "g": by(g) / (x @ x) ** 2 * levels / (levels - 1) * (n - 1) / (n - 2)}
    for kind, v in want.items():
        fit = panel.feols(d, "y", ["x"], ["g"], **({"cluster": kind} if kind in "cg" else {"vcov": kind}))
        assert (fit.n, fit.extra["levels"], fit.extra["absorbed"]) == (400, [levels], levels)
        assert fit["x"] == pytest.approx(b, rel=1e-8) and fit.stderr("x") == pytest.approx(math.sqrt(v), rel=1e-8), kind

    def refuse(*_):
        raise AssertionError("rows are written")

    monkeypatch.setattr(panel, "written", refuse)
    assert panel.feols(d, "y", ["x"], ["g"])["x"] == pytest.approx(b, rel=1e-8)
    with pytest.raises(core.DataInsufficient, match="no usable rows"):
        panel.feols(d.where("g >= 100"), "y", ["x"], ["g"])
