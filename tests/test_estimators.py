"""Estimators against dense NumPy twins, published values and effects planted in generated data."""

import math

import numpy as np
import pandas as pd
import pytest
from abacist.functions import dist
from abacist.operators import causal, core, describe, did, graph, inequality, learn, panel, rd, regression, resample, series, survey, survival
from abacist.sources import io, simulate
from abacist.streaming import folds
from pyspark.sql import functions as F


def test_distributions():
    assert dist.norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228138851964939, abs=1e-9)
    assert dist.chi2_ppf(0.95, 3) == pytest.approx(7.814727903251179, abs=1e-8)
    assert dist.f_sf(4.0, 2, 20) == pytest.approx(1.4**-10, rel=1e-12)
    assert dist.two_sided(1.96) == pytest.approx(0.0499957902964409, abs=1e-12)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(size=(n, 3))
    c = rng.integers(0, 25, n)
    y = 1 + x @ [1.0, -2.0, 0.5] + rng.normal(size=n) * (1 + np.abs(x[:, 0])) + 0.3 * c / 25
    pdf = pd.DataFrame({"y": y, "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "c": c, "g": c % 7, "t": np.arange(n), "w": rng.uniform(0.5, 2, n)})
    return pdf, spark.createDataFrame(pdf).repartition(4).cache()


def design(pdf):
    return np.column_stack([np.ones(len(pdf)), pdf[["x1", "x2", "x3"]]])


def test_sandwiches_against_dense(data):
    pdf, df = data
    X, y = design(pdf), pdf.y.to_numpy()
    bread = np.linalg.inv(X.T @ X)
    b = bread @ X.T @ y
    e = y - X @ b
    h = np.einsum("ij,jk,ik->i", X, bread, X)
    n, k = X.shape
    want = {"nonrobust": e @ e / (n - k) * bread}
    for kind, u in (("HC0", e), ("HC1", e * math.sqrt(n / (n - k))), ("HC2", e / np.sqrt(1 - h)), ("HC3", e / (1 - h))):
        want[kind] = bread @ (X.T * u**2) @ X @ bread
    for kind, v in want.items():
        fit = regression.regress("y ~ x1 + x2 + x3", df, vcov=kind)
        assert np.allclose(fit.beta, b) and np.allclose(fit.vcov, v)
    s = X * e[:, None]
    v = sum((1 if l == 0 else 1 - l / 5) * (a + a.T if l else a) for l in range(5) for a in [s[l:].T @ s[: n - l]])
    assert np.allclose(regression.regress("y ~ x1 + x2 + x3", df, vcov="HAC", order="t", lags=4).vcov, bread @ v @ bread * n / (n - k))

    def clustered(ids):
        sums = pd.DataFrame(s).groupby(ids).sum().to_numpy()
        g = len(sums)
        return bread @ sums.T @ sums @ bread * g / (g - 1) * (n - 1) / (n - k)

    assert np.allclose(regression.regress("y ~ x1 + x2 + x3", df, cluster="c").vcov, clustered(pdf.c.to_numpy()))
    both = clustered(pdf.c.to_numpy()) + clustered(pdf.g.to_numpy()) - clustered((pdf.c * 100 + pdf.g).to_numpy())
    assert np.allclose(regression.regress("y ~ x1 + x2 + x3", df, cluster=["c", "g"]).vcov, core.psd(both))


def test_nulls_and_collinear(spark):
    d = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 2.0, 4.0), (None, 3.0, 6.0), (4.0, float("nan"), 1.0), (3.5, 4.0, 8.0), (1.0, 0.0, 0.0)], "y double, a double, b double")
    assert regression.ols(d, "y", ["a"]).n == 4
    with pytest.raises(core.DataInsufficient):
        regression.ols(d, "y", ["a", "b"])
    with pytest.raises(core.DataInsufficient):
        regression.ols(d.where("false"), "y", ["a"])


def test_formula():
    y, terms, absorbed, intercept = regression.parse("log(y) ~ a + b:c + I(a**2) + C(g) - 1 | f1 + f2")
    assert (y, absorbed, intercept) == ("log(y)", ["f1", "f2"], False)
    assert terms[0] == "a" and terms[1][0] == "b:c" and terms[2][0] == "I(a**2)" and terms[3] == ("factor", "g")


def test_fixed_effects_against_dummies(data):
    pdf, df = data
    fit = regression.regress("y ~ x1 + x2 | c + g", df)
    D = np.column_stack([pdf[["x1", "x2"]], pd.get_dummies(pdf.c), pd.get_dummies(pdf.g).iloc[:, 1:]]).astype(float)
    assert np.allclose(fit.beta, np.linalg.lstsq(D, pdf.y, rcond=None)[0][:2], atol=1e-6)


def test_glm_against_newton(data, spark):
    pdf, df = data
    p = pdf.assign(b=(pdf.y > 1).astype(float), k=np.random.default_rng(1).poisson(np.exp(0.3 * pdf.x1)).astype(float))
    d, X = spark.createDataFrame(p), design(p)
    for family, y, mean in (("logit", p.b, lambda e: 1 / (1 + np.exp(-e))), ("poisson", p.k, np.exp)):
        b = np.zeros(4)
        for _ in range(60):
            m = mean(X @ b)
            w = m * (1 - m) if family == "logit" else m
            b = b + np.linalg.solve((X.T * w) @ X, X.T @ (y - m))
        fit = regression.glm(d, y.name, ["x1", "x2", "x3"], family=family)
        assert np.allclose(fit.beta, b, atol=1e-7) and np.allclose(fit.vcov, np.linalg.inv((X.T * w) @ X), rtol=1e-5)
    probit = regression.glm(d, "b", ["x1", "x2", "x3"], family="probit")
    assert np.allclose(probit.beta * 1.65, regression.glm(d, "b", ["x1", "x2", "x3"]).beta, atol=0.35)


def test_instruments(spark):
    d = simulate.instrument(spark, 4000)
    pdf = d.toPandas()
    Z, X = np.column_stack([np.ones(4000), pdf.x1, pdf.instrument]), np.column_stack([np.ones(4000), pdf.treatment, pdf.x1])
    b = np.linalg.solve(Z.T @ X, Z.T @ pdf.y)
    for method in ("2sls", "liml"):
        fit = regression.iv(d, "y", ["treatment"], ["instrument"], ["x1"], method=method)
        assert np.allclose(fit.beta, b) and abs(fit["treatment"] - 1) < 4 * fit.stderr("treatment")
    assert regression.ols(d, "y", ["treatment", "x1"])["treatment"] > 1.2  # the bias that the instrument removes
    assert fit.extra["first_stage_f"][0] > 100


def test_staggered_designs_recover_the_effect(spark):
    d = simulate.staggered(spark, 240, 9, effect=1.0).cache()
    cells = did.att_gt(d, "y", "first_treat", "unit", "time")
    assert did.aggte(cells, "simple").first().att == pytest.approx(1, abs=0.15)
    assert did.imputation(d, "y", "first_treat", "unit", "time").where("e is null").first().att == pytest.approx(1, abs=0.1)
    assert did.stacked(d, "y", "first_treat", "unit", "time", (-2, 2)).extra["att"] == pytest.approx(1, abs=0.15)
    assert all(abs(r.att - 1) < 0.4 for r in did.sun_abraham(d, "y", "first_treat", "unit", "time", (-3, 2)).where("e >= 0").collect())
    b = did.bacon(d, "y", "first_treat", "unit", "time").collect()
    assert sum(r.weight for r in b) == pytest.approx(1)
    assert sum(r.weight * r.estimate for r in b) == pytest.approx(did.twfe(d, "y", "treated", "unit", "time")["treated"], abs=1e-5)


def test_panel_estimators(spark):
    d = simulate.panel(spark).cache()
    assert panel.feols(d, "y", ["x"], ["unit", "time"])["x"] == pytest.approx(0.7, abs=0.1)
    assert panel.random_effects(d, "y", ["x"], "unit")["x"] > panel.feols(d, "y", ["x"], ["unit"])["x"]
    assert panel.mundlak(d, "y", ["x"], "unit")["x"] == pytest.approx(panel.feols(d, "y", ["x"], ["unit"])["x"], abs=1e-6)


def test_observational_estimators(spark):
    d = simulate.observational(spark, 4000).cache()
    x = ["x1", "x2"]
    naive = d.agg((F.avg(F.when(F.col("treatment") == 1, F.col("y"))) - F.avg(F.when(F.col("treatment") == 0, F.col("y"))))).first()[0]
    assert naive > 2.3
    for got in (causal.ipw(d, "y", "treatment", x), causal.g_computation(d, "y", "treatment", x), causal.aipw(d, "y", "treatment", x, "id"), causal.dml_plr(d, "y", "treatment", x, "id"), causal.att_by_matching(d, "y", "treatment", x, "id")):
        assert got["estimate"] == pytest.approx(2, abs=0.2)
    for kind in ("s", "t", "x", "r", "dr"):
        assert causal.meta_learner(d, "y", "treatment", x, kind).agg(F.avg("cate")).first()[0] == pytest.approx(2, abs=0.2)
    e = causal.entropy_balance(d, "treatment", x)
    m = e.groupBy("treatment").agg(*[(F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c) for c in x]).collect()
    assert m[0].x1 == pytest.approx(m[1].x1, abs=1e-6) and m[0].x2 == pytest.approx(m[1].x2, abs=1e-6)


def test_nearest_matches_against_all_pairs(spark):
    d = simulate.observational(spark, 300)
    got = {(r.id, r["rank"]): r.distance for r in causal.match_nearest(d, "treatment", ["x1", "x2"], "id", k=2, caliper=0.2).collect()}
    ps = causal.propensity(d, "treatment", ["x1", "x2"], 1e-6, ("id",)).withColumn("ps", F.round("ps", 6)).toPandas()
    c = ps[ps.treatment == 0].ps.to_numpy()
    for i, p in ps[ps.treatment == 1][["id", "ps"]].itertuples(index=False):
        near = np.sort(np.abs(c - p))[:2]
        assert [got[i, k + 1] for k in range(2) if (i, k + 1) in got] == pytest.approx([v for v in near if v <= 0.2], abs=1e-9)


def test_survival_against_loops(spark):
    d = simulate.survival(spark, 400)
    pdf = d.toPandas()
    km = {r.time: r.survival for r in survival.kaplan_meier(d, "time", "event").collect()}
    s = 1.0
    for t in sorted(pdf.time.unique()):
        at, dead = (pdf.time >= t).sum(), ((pdf.time == t) & (pdf.event == 1)).sum()
        s *= 1 - dead / at
        if dead:
            assert km[t] == pytest.approx(s)

    def efron(b):
        ll = 0.0
        for t in sorted(pdf[pdf.event == 1].time.unique()):
            risk, dead = pdf[pdf.time >= t], pdf[(pdf.time == t) & (pdf.event == 1)]
            m = len(dead)
            ll += b * dead.x.sum() - sum(math.log(np.exp(b * risk.x).sum() - j / m * np.exp(b * dead.x).sum()) for j in range(m))
        return ll

    fit = survival.cox(d, "time", "event", ["x"])
    b, h = fit["x"], 1e-4
    assert b == pytest.approx(math.log(2), abs=0.3) and abs(efron(b + h) - efron(b - h)) / (2 * h) < 1e-3
    assert fit.stderr("x") == pytest.approx((-(efron(b + h) - 2 * efron(b) + efron(b - h)) / h**2) ** -0.5, rel=1e-3)


def test_discontinuities(spark):
    d = simulate.discontinuity(spark)
    assert rd.rd(d, "y", "x", bandwidth=0.4)["estimate"] == pytest.approx(1, abs=0.1)
    f = simulate.discontinuity(spark, fuzzy=True)
    assert rd.rd(f, "y", "x", bandwidth=0.4, fuzzy="treatment")["estimate"] == pytest.approx(1, abs=0.2)
    assert rd.density_test(d, "x")["p_value"] > 0.01
    assert rd.bunching(simulate.bunched(spark), "income", 100.0, 1.0)["b"] > 2


def test_lasso_conditions(data):
    pdf, df = data
    lam = 0.3
    b = learn.elastic_net(df, "y", ["x1", "x2", "x3"], lam)
    z = (pdf[["x1", "x2", "x3"]] - pdf[["x1", "x2", "x3"]].mean()) / pdf[["x1", "x2", "x3"]].std(ddof=0)
    beta = np.array([b[c] for c in z]) * pdf[["x1", "x2", "x3"]].std(ddof=0).to_numpy()
    g = z.T @ (pdf.y - pdf.y.mean() - z @ beta) / len(z)
    for v, s in zip(beta, g):
        assert s == pytest.approx(lam * np.sign(v), abs=1e-8) if v else abs(s) <= lam + 1e-8


def test_bootstrap_and_permutation(spark):
    d = simulate.rct(spark, 1000)
    draws = resample.bootstrap(d, resample.weighted_mean("y"), ["id"], 200)
    m, sd, n = d.agg(F.avg("y"), F.stddev("y"), F.count("*")).first()
    assert resample.summary(draws, m)["std_error"] == pytest.approx(sd / math.sqrt(n), rel=0.2)
    assert resample.permutation(d, "y", "treatment", "id", replicates=100)["p_value"] < 0.02


def test_raking_meets_margins(spark):
    d = simulate.rct(spark, 500).withColumns({"a": F.col("id") % 3, "b": F.col("id") % 2})
    r = survey.rake(d, {"a": {0: 0.2, 1: 0.3, 2: 0.5}, "b": {0: 0.7, 1: 0.3}}, tol=1e-12)
    for c, goal in (("a", {0: 0.2, 1: 0.3, 2: 0.5}), ("b", {0: 0.7, 1: 0.3})):
        for v in r.groupBy(c).agg(F.sum("raked").alias("s")).collect():
            assert v.s == pytest.approx(goal[v[0]], abs=1e-6)


def test_synthetic_control(spark):
    r = series.synthetic_control(simulate.synthetic(spark), "y", "unit", "time", 0, 20)
    assert r["att"] == pytest.approx(3, abs=0.4) and sum(r["weights"].values()) == pytest.approx(1) and r["p_value"] <= 2 / 12
    us, ts, m = series._wide(simulate.synthetic(spark), "y", "unit", "time")
    pre = np.array([t < 20 for t in ts])
    assert series._placebos(spark, m, pre) == pytest.approx([series._ratio(series._gap(m, pre, i)[0], pre) for i in range(len(us))])
    with pytest.raises(core.DataInsufficient, match="treated unit"):
        series.synthetic_control(simulate.synthetic(spark), "y", "unit", "time", 99, 20)


def test_inequality_bounds(spark):
    equal = spark.range(100).select(F.lit(5.0).alias("y"))
    one = spark.range(1000).select(F.when(F.col("id") == 0, 1.0).otherwise(0.0).alias("y"))
    assert inequality.gini(equal, "y").first().gini == pytest.approx(0) and inequality.gini(one, "y").first().gini == pytest.approx(0.999)


def test_balke_pearl_contains_truth_and_tight(spark):
    perfect = spark.createDataFrame([(float(i % 2), float(i % 2), float(i % 2)) for i in range(100)], "y double, d double, z double")
    assert causal.balke_pearl(perfect, "y", "d", "z") == {"lower": 1.0, "upper": 1.0}


def test_table_helpers(spark):
    d = spark.createDataFrame([(1, 2.0), (2, None), (3, 2.0), (4, 7.0), (5, float("nan"))], "i int, x double")
    assert describe.fingerprint(d) == describe.fingerprint(d.repartition(3).orderBy(F.desc("i")))
    s = describe.sumstats(d, ["x"]).first()
    assert (s.n, s["mean"], s["median"]) == (3, pytest.approx(11 / 3), 2.0)
    lab = io.labelled(d, {"x": "income"})
    assert io.labels_of(lab.select("x")) == {"x": "income"}


def test_payloads(spark, tmp_path):
    wb = '[{"page":1},[{"countryiso3code":"FRA","date":"2020","value":1.5,"indicator":{"id":"NY"}},{"countryiso3code":"FRA","date":"2021","value":null,"indicator":{"id":"NY"}}]]'
    got = io.from_worldbank(spark, spark.createDataFrame([(wb,)], "value string")).collect()
    assert [tuple(r) for r in got] == [("FRA", "NY", 2020, 1.5), ("FRA", "NY", 2021, None)]
    fred = '{"observations":[{"date":"2020-01-01","value":"3.5"},{"date":"2020-02-01","value":"."}]}'
    assert [r.value for r in io.from_fred(spark, spark.createDataFrame([(fred,)], "value string")).collect()] == [3.5, None]
    sdmx = '{"dataSets":[{"series":{"0:1":{"observations":{"0":[1.0],"1":[2.0]}}}}],"structure":{"dimensions":{"series":[{"values":[{"id":"A"}]},{"values":[{"id":"DE"},{"id":"FR"}]}],"observation":[{"values":[{"id":"2020"},{"id":"2021"}]}]}}}'
    assert sorted(tuple(r) for r in io.from_sdmx(spark, spark.createDataFrame([(sdmx,)], "value string")).collect()) == [("A.FR", "2020", 1.0), ("A.FR", "2021", 2.0)]
    for name in ("t.csv", "t.tsv", "t.parquet", "t.jsonl", "t.orc"):
        io.write(spark.range(5).selectExpr("id", "id * 2 as d"), str(tmp_path / name))
        assert io.read(spark, str(tmp_path / name), ["d"]).agg(F.sum("d")).first()[0] == 20
    with pytest.raises(ValueError):
        io.read(spark, "x.sav7")


def test_generators_do_not_depend_on_partitions(spark):
    a = describe.fingerprint(simulate.rct(spark, 200))
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert describe.fingerprint(simulate.rct(spark, 200)) == a
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_streams_equal_batches(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("se", F.lit(2.0)).orderBy("ts").limit(600)
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    events = spark.read.parquet(str(tmp_path / "in")).cache()
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def drained(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(tuple(r) for r in spark.table(name).collect())

    w = drained(folds.windowed(stream, "ts", "value", ["event_type"], "1 hour", late="1 hour"), "w", "complete")
    assert [r[:4] for r in w] == [tuple(r)[:4] for r in sorted(tuple(r) for r in folds.windowed(events, "ts", "value", ["event_type"], "1 hour").collect())]
    k = drained(folds.kalman_stream(stream, "user_id", "event_id", "value", "se"), "k", "append")
    batch = {r.user_id: 0 for r in events.select("user_id").distinct().collect()}
    last = {r[0]: r for r in k}
    final = folds.kalman_batch(events, "user_id", "event_id", "value", "se")
    assert len(k) == events.count() and set(last) == set(batch)
    post = {r.user_id: r for r in final.groupBy("user_id").agg(F.min_by("mean", "variance").alias("mean"), F.min("variance").alias("v")).collect()}
    best = {}
    for r in k:
        if r[0] not in best or r[3] < best[r[0]][3]:
            best[r[0]] = r
    assert all(best[u][2] == pytest.approx(post[u]["mean"]) and best[u][3] == pytest.approx(post[u].v) for u in post)


def test_graph_without_triangles(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (10, 11, 1.0)], "src long, dst long, w double")
    assert {r.node: r.component for r in graph.connected(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}
    assert graph.triangles(e).agg(F.sum("triangles")).first()[0] == 0
    assert graph.pagerank(e).agg(F.sum("rank")).first()[0] == pytest.approx(1)


def test_instrument_that_varies_little_about_a_large_mean(spark):
    rows = [(float(i % 7 + 3 * (i % 5)), float(i % 5 + i % 3), 1e7 + i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "y double, d double, z double")
    far = regression.iv(df, "y", ["d"], ["z"], vcov="HC1")
    near = regression.iv(df.withColumn("z", F.col("z") - 1e7), "y", ["d"], ["z"], vcov="HC1")
    for name in ("Intercept", "d"):
        assert abs(far[name] - near[name]) < 1e-7 and abs(far.stderr(name) - near.stderr(name)) < 1e-7
    with pytest.raises(core.DataInsufficient):
        regression.iv(df.withColumn("z", F.lit(0.1)), "y", ["d"], ["z"])
