"""Queries of limited outcomes, mixed and dynamic models, experiments and robustness checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.operators import experiments as X
from abacist.operators import graph, likelihood, panel
from abacist.plans.graphs import _points
from abacist.plans.models import PANEL, _panel, _slopes
from abacist.plans.registry import Tables, one, query


def _line(t: Tables):
    return t.lineitem.select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("k"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("z"), F.col("l_returnflag").alias("f"), (F.col("l_quantity") > 25).cast("double").alias("b"), (F.col("l_returnflag") == "R").cast("double").alias("t"), F.col("l_linenumber").alias("c"), (F.col("l_linestatus") == "O").cast("double").alias("s"))


LINE = "SELECT l_extendedprice y, l_quantity x, l_discount z, l_returnflag f, (l_quantity > 25)::INT b, (l_returnflag = 'R')::INT t, l_linenumber c, (l_linestatus = 'O')::INT s FROM lineitem"


@query("multinomial", f"WITH n AS (SELECT f, b, count(*)::DOUBLE n FROM ({LINE}) GROUP BY 1, 2), w AS (SELECT f, sum(n) FILTER (b = 1) a, sum(n) FILTER (b = 0) c FROM n GROUP BY 1), o AS (SELECT a a0, c c0 FROM w ORDER BY f LIMIT 1) SELECT f || ':b' AS term, round(ln(a*c0/(c*a0)), 6) AS estimate, round(sqrt(1/a+1/c+1/a0+1/c0), 6) AS std_error FROM w, o WHERE f <> (SELECT min(f) FROM w)")
def _(t):
    return likelihood.multinomial(_line(t), "f", ["b"]).frame(t.spark).where("term like '%:b'").select("term", "estimate", "std_error")


@query("ordered_logit")
def _(t):
    return likelihood.ordered_logit(_line(t), "c", ["x", "z"]).frame(t.spark).select("term", "estimate", "std_error")


@query("negative_binomial", f"SELECT 'b' AS term, round(ln(avg(c) FILTER (b = 1)/avg(c) FILTER (b = 0)), 6) AS estimate FROM ({LINE})")
def _(t):
    return _slopes(likelihood.negative_binomial(_line(t), "c", ["b"]), t).select("term", "estimate")


@query("tobit")
def _(t):
    return likelihood.tobit(_line(t).withColumn("v", F.greatest(F.col("y") / 1000 - 20, F.lit(0.0))), "v", ["b"]).frame(t.spark).select("term", "estimate", "std_error")


@query("heckman")
def _(t):
    return _slopes(likelihood.heckman(_line(t), "y", ["x"], "s", ["x", "z"]), t)


@query("quantile_regression")
def _(t):
    return _slopes(likelihood.quantile_regression(_line(t), "y", ["x"]), t)


@query("random_intercept")
def _(t):
    f = likelihood.random_intercept(t.lineitem, "l_extendedprice", ["l_quantity"], "l_suppkey")
    return one(t.spark, {"slope": f["l_quantity"], "sigma_e": f.extra["sigma_e"], "sigma_u": f.extra["sigma_u"]})


@query("anderson_hsiao", f"WITH d AS (SELECT i, y - lag(y) OVER w dy, lag(y) OVER w - lag(y, 2) OVER w l, lag(y, 2) OVER w z FROM ({PANEL}) WINDOW w AS (PARTITION BY i ORDER BY t)), f AS (SELECT i, dy - avg(dy) OVER () dy, l - avg(l) OVER () l, z - avg(z) OVER () z FROM d WHERE z IS NOT NULL), k AS (SELECT sum(z*dy)/sum(z*l) b, sum(z*l) zl, count(*) n FROM f), c AS (SELECT i, sum(z*(dy - b*l)) s FROM f, k GROUP BY i) SELECT 'lag_dy' AS term, round(any_value(b), 5) AS estimate, round(sqrt(sum(s*s)*count(*)/(count(*) - 1.0)*any_value((n - 1.0)/(n - 2)))/abs(any_value(zl)), 5) AS std_error FROM c, k", 5)
def _(t):
    return _slopes(likelihood.anderson_hsiao(_panel(t), "y", "i", "t"), t)


@query("arellano_bond")
def _(t):
    return _slopes(likelihood.arellano_bond(_panel(t), "y", "i", "t"), t)


@query("assign")
def _(t):
    return X.assign(t.orders, ["o_orderkey"], {"a": 1, "b": 1, "c": 2}, ["o_orderstatus"]).groupBy("o_orderstatus", "arm").count()


@query("sample_ratio", "WITH n AS (SELECT o_orderstatus, count(*)::DOUBLE n FROM orders GROUP BY 1), t AS (SELECT sum(n) t FROM n) SELECT round(sum(power(n - t/3, 2)/(t/3)), 6) AS chi2 FROM n, t")
def _(t):
    return one(t.spark, {"chi2": X.sample_ratio(t.orders, "o_orderstatus", {"F": 1, "O": 1, "P": 1})[0]})


@query("cuped", f"WITH d AS ({LINE}), k AS (SELECT covar_pop(y, x)/var_pop(x) th, avg(x) m FROM d), a AS (SELECT t, y - th*(x-m) AS a FROM d, k) SELECT round(avg(a) FILTER (t = 1) - avg(a) FILTER (t = 0), 4) AS estimate, round(sqrt(var_samp(a) FILTER (t = 1)/count(*) FILTER (t = 1) + var_samp(a) FILTER (t = 0)/count(*) FILTER (t = 0)), 4) AS std_error, (SELECT round(th, 4) FROM k) AS theta FROM a", 4)
def _(t):
    r = X.cuped(_line(t), "y", "t", "x")
    return one(t.spark, {k: r[k] for k in ("estimate", "std_error", "theta")})


@query("lin_adjusted", f"WITH d AS ({LINE}), k AS (SELECT regr_slope(y, b) FILTER (t = 1) b1, regr_intercept(y, b) FILTER (t = 1) a1, regr_slope(y, b) FILTER (t = 0) b0, regr_intercept(y, b) FILTER (t = 0) a0, avg(b) m FROM d) SELECT 't' AS term, round(a1 - a0 + (b1 - b0)*m, 4) AS estimate FROM k", 4)
def _(t):
    return X.lin_adjusted(_line(t), "y", "t", ["b"]).frame(t.spark).where("term = 't'").select("term", "estimate")


@query("difference_in_means", f"WITH a AS (SELECT f, avg(y) m, var_samp(y) v, count(*) n FROM ({LINE}) GROUP BY 1) SELECT x.f AS arm, round(x.m - o.m, 4) AS estimate, round(sqrt(x.v/x.n + o.v/o.n), 4) AS std_error, x.n AS n FROM a x, a o WHERE x.f <> 'A' AND o.f = 'A'", 4)
def _(t):
    return X.difference_in_means(_line(t), "y", "f", "A")


@query("uplift_curve", f"WITH p AS (SELECT z AS s, count(*) n, sum(t) n1, sum(t*y) y1, sum((1-t)*y) y0 FROM ({LINE}) GROUP BY 1), r AS (SELECT sum(n) OVER w / sum(n) OVER () AS share, sum(n) OVER w n, sum(n1) OVER w n1, sum(y1) OVER w y1, sum(y0) OVER w y0 FROM p WINDOW w AS (ORDER BY s DESC)), g AS (SELECT share, y1 - CASE WHEN n > n1 THEN y0*n1/(n-n1) ELSE 0 END AS gain FROM r) SELECT ceil(round(share*10, 9))::BIGINT AS bin, round(max(share), 3) AS share, round(arg_max(gain, share), 3) AS gain FROM g GROUP BY 1", 3)
def _(t):
    return X.uplift_curve(_line(t), "y", "t", "z")


@query("tmle")
def _(t):
    return one(t.spark, X.tmle(_line(t), "y", "t", ["x", "z"]))


@query("marginal_structural")
def _(t):
    # last year's quantity may drive this year's treatment without deciding it
    p = panel.lag_lead(_panel(t), "x", "i", "t").withColumn("a", (F.col("x") > 25.5).cast("double"))
    return _slopes(X.marginal_structural(p, "y", "a", "i", "t", ["L1_x"]), t)


@query("bartik", "WITH h AS (SELECT l_linenumber c, avg(l_discount) h FROM lineitem GROUP BY 1), n AS (SELECT l_suppkey r, l_linenumber c, count(*)::DOUBLE n FROM lineitem GROUP BY 1, 2), z AS (SELECT r, sum(n*h)/sum(n) z FROM n JOIN h USING (c) GROUP BY 1), d AS (SELECT l_suppkey r, avg(l_extendedprice) y, avg(l_quantity) x FROM lineitem GROUP BY 1), f AS (SELECT y - avg(y) OVER () y, x - avg(x) OVER () x, z - avg(z) OVER () z FROM d JOIN z USING (r)), k AS (SELECT sum(z*y)/sum(z*x) b, sum(z*x) zx, count(*)::DOUBLE n FROM f) SELECT 'x' AS term, round(any_value(b), 3) AS estimate, round(sqrt(sum(z*z*power(y - b*x, 2))*any_value(n/(n-2)))/abs(any_value(zx)), 3) AS std_error FROM f, k", 3)
def _(t):
    s = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    total = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("total"))
    shares = s.join(total, "l_suppkey").select("l_suppkey", "l_linenumber", (F.col("n") / F.col("total")).alias("share"))
    shocks = t.lineitem.groupBy("l_linenumber").agg(F.avg("l_discount").alias("shock"))
    y = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("y"), F.avg("l_quantity").alias("x"))
    return _slopes(X.bartik(y, shares, shocks, "y", "x", "l_suppkey", "l_linenumber", "share", "shock"), t)


@query("proximal")
def _(t):
    return _slopes(X.proximal(_line(t), "y", "t", "z", "x"), t)


@query("robustness_value", f"WITH d AS ({LINE}), k AS (SELECT regr_r2(y, t) r, regr_slope(y, t) b, count(*) n FROM d), q AS (SELECT *, sqrt(r/(1-r)) f FROM k) SELECT round(b, 5) AS estimate, round(r, 5) AS partial_r2, round(0.5*(sqrt(power(f, 4)+4*f*f)-f*f), 5) AS robustness_value FROM q", 5)
def _(t):
    r = X.robustness_value(_line(t), "y", "t", [])
    return one(t.spark, {k: r[k] for k in ("estimate", "partial_r2", "robustness_value")})


@query("specification_curve", f"WITH d AS ({LINE}), s AS (SELECT covar_pop(t,b) tb, var_pop(t) tt, var_pop(b) bb, covar_pop(t,y) ty, covar_pop(b,y) yb FROM d) SELECT '' AS controls, round(ty/tt, 4) AS estimate FROM s UNION ALL SELECT 'b', round((bb*ty-tb*yb)/(tt*bb-tb*tb), 4) FROM s", 4)
def _(t):
    return X.specification_curve(_line(t), "y", "t", ["b"]).select("controls", "estimate")


@query("placebo_outcomes", f"WITH d AS ({LINE}) " + " UNION ALL ".join(f"SELECT '{c}' AS outcome, round(avg({c}) FILTER (t = 1) - avg({c}) FILTER (t = 0), 6) AS estimate, round(sqrt(var_samp({c}) FILTER (t = 1)/count(*) FILTER (t = 1) + var_samp({c}) FILTER (t = 0)/count(*) FILTER (t = 0)), 6) AS std_error FROM d" for c in ("x", "z")))
def _(t):
    return X.placebo_outcomes(_line(t), ["x", "z"], "t").drop("p_adjusted")


@query("romano_wolf")
def _(t):
    return X.romano_wolf(_line(t), ["y", "x", "z"], "t", ["k"], 50)


@query("dose_response")
def _(t):
    return X.dose_response(_line(t), "y", "x", ["z", "c"])


@query("policy_tree")
def _(t):
    r = X.policy_tree(_line(t), "y", "t", ["x", "z"])
    return t.spark.createDataFrame([(r["value"], r["feature"], r["cut"], r["treat_above"])], "value double, feature string, cut double, treat_above boolean")


@query("rosenbaum")
def _(t):
    d = t.lineitem.groupBy("l_suppkey").agg((F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))) - F.avg(F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice")))).alias("gap"))
    return one(t.spark, {f"gamma_{int(10 * g)}": X.rosenbaum(d, "gap", g) for g in (1.0, 1.5, 2.0)})


@query("spatial_2sls")
def _(t):
    p = _points(t).withColumn("u", (F.col("id") * 7 % 13).cast("double"))
    return _slopes(X.spatial_2sls(graph.distance_band(p, 1.5, True), p, "v", ["u"]), t)


@query("chow", f"WITH d AS ({LINE}), r AS (SELECT s, regr_syy(y, x) - regr_slope(y, x)*regr_slope(y, x)*regr_sxx(y, x) q, count(*) n FROM d GROUP BY s), p AS (SELECT regr_syy(y, x) - regr_slope(y, x)*regr_slope(y, x)*regr_sxx(y, x) q FROM d) SELECT round(((SELECT q FROM p) - sum(q))/2/(sum(q)/(sum(n)-4)), 5) AS f FROM r", 5)
def _(t):
    return one(t.spark, {"f": X.chow(_line(t), "y", ["x"], "s")[0]})


@query("dickey_fuller")
def _(t):
    return one(t.spark, {"t": X.dickey_fuller(t.lineitem.withColumn("m", F.trunc("l_shipdate", "month")), "l_extendedprice", "m")})


@query("vector_autoregression")
def _(t):
    return X.vector_autoregression(t.lineitem.withColumn("m", F.trunc("l_shipdate", "month")), ["l_extendedprice", "l_quantity"], "m")
