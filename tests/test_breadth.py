"""Running sums in cells, classical tests, tables, weighting and networks against NumPy twins and odd inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from abacist.operators import core, describe, epi, graph, hypothesis, inequality, series, survival, tabulate, weighting
from abacist.sources import simulate
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"v": rng.exponential(size=900) ** 3, "g": rng.integers(0, 3, 900), "w": rng.integers(1, 5, 900)})
    return pdf, spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g") > 0, F.col("g")))  # a group without a name


@pytest.mark.parametrize("down", [False, True])
def test_running(values, down):
    pdf, df = values
    for fn in ("sum", "max", "min"):
        got = core.running(df, "v", {"w": F.col("w")}, ["g"], down=down, fn=fn).toPandas()
        assert len(got) == len(pdf) and set(got.columns) == {"v", "g", "w", "run_w", "all_w"}
        for _, part in got.groupby("g", dropna=False):
            part = part.sort_values("v", ascending=not down)
            assert (getattr(part.w, f"cum{fn}")() == part.run_w).all() and (part.all_w == getattr(part.w, fn)()).all()


def test_running_edges(spark):
    one = spark.createDataFrame([(1.0, 2)], "v double, w int")
    assert core.running(one, "v", {"w": F.col("w")}).first().run_w == 2
    assert core.running(one.where("false"), "v", {"w": F.col("w")}).count() == 0


def test_ranked(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", None), (None, 2.0), ("a", float("nan"))], "g string, v double")
    rows = describe.ranked(d, "v", {"mean": "average", "low": "min", "high": "max", "dense": "dense"}, ["g"]).collect()
    got = sorted((r.g or "", r.v, r.mean, r.low, r.high, r.dense) for r in rows if r.mean is not None)
    assert got == [("", 2.0, 1, 1, 1, 1), ("a", 1.0, 1, 1, 1, 1), ("a", 3.0, 2.5, 2, 3, 2), ("a", 3.0, 2.5, 2, 3, 2)]
    assert len(rows) == 6


def test_insufficient(spark):
    d = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (None, "b")], "y double, g string")
    for f in (hypothesis.t_test, hypothesis.anova, hypothesis.kruskal):
        with pytest.raises(core.DataInsufficient):
            f(d, "y", "g")
    with pytest.raises(core.DataInsufficient):
        weighting.coarsened_matching(d.withColumn("t", F.lit(1)), "y", "t", ["g"])


def test_known_values():
    assert epi.fisher_exact(3, 1, 1, 3)["p_value"] == pytest.approx(34 / 70)
    assert epi.fisher_exact(8, 2, 1, 5)["p_value"] == pytest.approx(0.03496503496503495)
    assert epi.fisher_exact(0, 5, 5, 0)["p_value"] == pytest.approx(2 / 252)
    assert weighting.relative_magnitude({-2: 0.1, 0: 1.0, 1: 1.2}, {-2: 0.1, 0: 0.1, 1: 0.1})[1][1:3] == pytest.approx((1.0, 1.4))


def test_tables(spark):
    d = spark.createDataFrame([(1, 1.0, None), (1, None, "x"), (2, float("nan"), "y"), (2, 4.0, "y")], "k int, v double, s string")
    assert [(r.present, r.missing) for r in tabulate.missing_table(d).collect()] == [(4, 0), (2, 2), (3, 1)]
    assert {r.pattern: r.n for r in tabulate.missing_patterns(d, ["v", "s"]).collect()} == {"+.": 1, ".+": 2, "++": 1}
    assert sorted(r.v for r in tabulate.impute(d, ["v"]).collect()) == [1.0, 2.5, 2.5, 4.0]
    assert sorted(r.v for r in tabulate.impute(d, ["v"], "mean", ["k"]).collect()) == [1.0, 1.0, 4.0, 4.0]
    assert tabulate.hot_deck(d, "v", ["k"], ["k", "s"]).where("v is null").count() == 0
    empty = d.where("false")
    assert tabulate.missing_table(empty).count() == 3 and tabulate.hot_deck(empty, "v", ["k"], ["k"]).count() == 0
    assert tabulate.panel_describe(d, "k", "v").first().units == 2


def test_networks(spark):
    pairs = [(a, b) for a in range(4) for b in range(a)] + [(4, 0), (5, 4)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src int, dst int, w double")
    assert {r.node: r.core for r in graph.core_numbers(e).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1}
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    m = np.zeros((6, 6))
    for a, b in pairs:
        m[a, b] = m[b, a] = 1
    u = np.abs(np.linalg.eigh(m)[1][:, -1])
    assert [r.x for r in graph.eigenvector_centrality(both).orderBy("node").collect()] == pytest.approx(u.tolist(), abs=1e-6)
    k = np.linalg.solve(np.eye(6) - 0.1 * m, np.ones(6))
    assert [r.x for r in graph.katz_centrality(both, 0.1).orderBy("node").collect()] == pytest.approx((k / np.linalg.norm(k)).tolist(), abs=1e-6)
    d = np.zeros((6, 6))
    for a, b in pairs:
        d[a, b] = 1
    hub, authority = np.abs(np.linalg.svd(d)[0][:, 0]), np.abs(np.linalg.svd(d)[2][0])
    rows = graph.hits(e).orderBy("node").collect()
    assert [r.hub for r in rows] == pytest.approx(hub.tolist(), abs=1e-5) and [r.authority for r in rows] == pytest.approx(authority.tolist(), abs=1e-5)
    steps = {r.node: r.steps for r in graph.path_lengths(both, spark.createDataFrame([(5,)], "node int")).collect()}
    assert steps == {5: 0, 4: 1, 0: 2, 1: 3, 2: 3, 3: 3}


def test_planted_effects(spark):
    assert series.synthetic_did(simulate.synthetic(spark, effect=3.0), "y", "unit", "time", [0], 20)["att"] == pytest.approx(3.0, abs=0.8)
    rng = np.random.default_rng(5)
    n = 8000
    g, t = rng.integers(0, 2, n), rng.integers(0, 2, n)
    y = np.exp(rng.normal(size=n) + 0.5 * g + 0.7 * t) + 2.0 * g * t
    d = spark.createDataFrame(pd.DataFrame({"y": y, "g": g, "t": t}))
    assert weighting.changes_in_changes(d, "y", "g", "t")["att"] == pytest.approx(2.0, abs=0.6)
    z = rng.integers(0, 4, n)
    arm = (rng.random(n) < 0.2 + 0.15 * z).astype(int)
    q = spark.createDataFrame(pd.DataFrame({"y": rng.normal(size=n) + z + 1.5 * arm, "t": arm, "z": z}))
    assert [r.effect for r in weighting.quantile_effects(q, "y", "t", ["z"]).collect()] == pytest.approx([1.5] * 3, abs=0.2)


def test_curves_by_group(spark):
    d = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 0), ("a", 1.0, 1), ("a", 2.0, 1), ("b", 3.0, 0)], "g string, t double, e int")
    rows = {(r.g, r.time): r.survival for r in survival.kaplan_meier(d, "t", "e", ["g"]).collect()}
    assert rows == pytest.approx({(None, 1.0): 0.5, ("a", 1.0): 0.5, ("a", 2.0): 0.0})
    area = {r.g: r.rmst for r in survival.rmst(d, "t", "e", 2.0, ["g"]).collect()}
    assert area == pytest.approx({None: 1.5, "a": 1.5, "b": 2.0})
    assert math.isclose(inequality.gini(d, "t").first().gini, 0.2222222222222222, abs_tol=1e-9)
