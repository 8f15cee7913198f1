"""Queries of regression models, instruments, panels and difference in differences."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from abacist.operators import did, inequality, learn, panel, regression, resample
from abacist.plans.registry import Tables, one, query


def fwl(sub: str, variance: str, digits: int = 6) -> str:
    """SQL of a regression of y on a and b (Frisch-Waugh): slopes and standard errors.  ``sub`` gives y, a, b and perhaps g, w."""
    v = {
        "plain": "(SELECT sum(e*e) FROM e) / (any_value(n) - 3) / sum(r*r)",
        "hc1": "sum(r*r*e*e) / (sum(r*r) * sum(r*r)) * any_value(n) / (any_value(n) - 3)",
        "hc3": "sum(r*r*e*e / ((1 - h) * (1 - h))) / (sum(r*r) * sum(r*r))",
    }.get(variance)
    head = f"""WITH d AS ({sub}), m AS (SELECT avg(y) my, avg(a) ma, avg(b) mb, count(*) n FROM d),
c AS (SELECT d.* EXCLUDE (y, a, b), y - my AS y, a - ma AS a, b - mb AS b, n FROM d, m),
s AS (SELECT sum(a*a) aa, sum(a*b) ab, sum(b*b) bb, sum(a*y) ay, sum(b*y) yb FROM c),
k AS (SELECT *, aa*bb - ab*ab AS det, (bb*ay - ab*yb) / (aa*bb - ab*ab) AS b1, (aa*yb - ab*ay) / (aa*bb - ab*ab) AS b2 FROM s),
e AS (SELECT c.* EXCLUDE (y, a, b), y - b1*a - b2*b AS e, 1.0/n + (bb*a*a - 2*ab*a*b + aa*b*b) / det AS h, a - ab/bb*b AS ra, b - ab/aa*a AS rb FROM c, k),
l AS (SELECT 'a' AS t, ra AS r, * EXCLUDE (ra, rb) FROM e UNION ALL SELECT 'b', rb, * EXCLUDE (ra, rb) FROM e)"""
    if variance == "cluster":
        return head + f""", g AS (SELECT t, g, sum(r*e) AS s, sum(r*r) AS rr, any_value(n) AS n FROM l GROUP BY t, g)
SELECT t AS term, round(CASE WHEN t = 'a' THEN (SELECT b1 FROM k) ELSE (SELECT b2 FROM k) END, {digits}) AS estimate,
  round(sqrt(sum(s*s) * count(*) / (count(*) - 1) * (sum(n)/count(*) - 1) / (sum(n)/count(*) - 3)) / sum(rr), {digits}) AS std_error FROM g GROUP BY t"""
    return head + f"""
SELECT t AS term, round(CASE WHEN t = 'a' THEN (SELECT b1 FROM k) ELSE (SELECT b2 FROM k) END, {digits}) AS estimate, round(sqrt({v}), {digits}) AS std_error FROM l GROUP BY t"""


LINE = "SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b, l_suppkey AS g FROM lineitem"


def _slopes(fit, t: Tables):
    return fit.frame(t.spark).where("term <> 'Intercept'").select("term", "estimate", "std_error")


def _line(t: Tables):
    return t.lineitem.select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_suppkey").alias("g"), F.col("l_tax").alias("w"), F.col("l_partkey").alias("p"))


@query("ols", fwl(LINE, "plain"))
def _(t):
    return _slopes(regression.regress("y ~ a + b", _line(t)), t)


@query("ols_hc1", fwl(LINE, "hc1"))
def _(t):
    return _slopes(regression.regress("y ~ a + b", _line(t), vcov="HC1"), t)


@query("ols_hc3", fwl(LINE, "hc3"))
def _(t):
    return _slopes(regression.regress("y ~ a + b", _line(t), vcov="HC3"), t)


@query("ols_cluster", fwl(LINE, "cluster"))
def _(t):
    return _slopes(regression.regress("y ~ a + b", _line(t), cluster="g"), t)


@query("ols_twoway_cluster", fwl(LINE.replace("AS g", "AS g, l_partkey AS p"), "cluster").split(", g AS (")[0] + """, z AS (SELECT t, sum(r*r) rr, any_value(n) n FROM l GROUP BY t),
s1 AS (SELECT t, sum(s*s)*count(*)/(count(*) - 1.0) q FROM (SELECT t, g, sum(r*e) s FROM l GROUP BY t, g) GROUP BY t), s2 AS (SELECT t, sum(s*s)*count(*)/(count(*) - 1.0) q FROM (SELECT t, p, sum(r*e) s FROM l GROUP BY t, p) GROUP BY t), s3 AS (SELECT t, sum(s*s)*count(*)/(count(*) - 1.0) q FROM (SELECT t, g, p, sum(r*e) s FROM l GROUP BY t, g, p) GROUP BY t)
SELECT t AS term, round(CASE WHEN t = 'a' THEN b1 ELSE b2 END, 6) AS estimate, round(sqrt((s1.q + s2.q - s3.q)*(n - 1.0)/(n - 3))/rr, 6) AS std_error FROM z JOIN s1 USING (t) JOIN s2 USING (t) JOIN s3 USING (t), k""")
def _(t):
    return _slopes(regression.regress("y ~ a + b", _line(t), cluster=["g", "p"]), t)


@query("wls", """WITH d AS (SELECT l_extendedprice y, l_quantity x, l_tax w FROM lineitem WHERE l_tax > 0), m AS (SELECT sum(w*y)/sum(w) my, sum(w*x)/sum(w) mx FROM d)
SELECT 'x' AS term, round(sum(w*(x-mx)*(y-my)) / sum(w*(x-mx)*(x-mx)), 6) AS estimate FROM d, m""")
def _(t):
    d = t.lineitem.select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("w"))
    return regression.ols(d, "y", ["x"], weights="w").frame(t.spark).where("term = 'x'").select("term", "estimate")


@query("ols_factor", """SELECT 'l_returnflag[' || f || ']' AS term, round(m - (SELECT avg(l_extendedprice) FROM lineitem WHERE l_returnflag = (SELECT min(l_returnflag) FROM lineitem)), 4) AS estimate
FROM (SELECT l_returnflag f, avg(l_extendedprice) m FROM lineitem GROUP BY 1) WHERE f <> (SELECT min(l_returnflag) FROM lineitem)""", 4)
def _(t):
    return regression.regress("l_extendedprice ~ C(l_returnflag)", t.lineitem).frame(t.spark).where("term <> 'Intercept'").select("term", "estimate")


@query("feols_oneway", """WITH d AS (SELECT l_suppkey g, l_extendedprice - avg(l_extendedprice) OVER w AS y, l_quantity - avg(l_quantity) OVER w AS x, count(*) OVER w AS c FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
f AS (SELECT * FROM d WHERE c > 1), k AS (SELECT sum(x*y)/sum(x*x) b, sum(x*x) xx, count(*) n, count(DISTINCT g) l FROM f)
SELECT 'l_quantity' AS term, round(any_value(b), 6) AS estimate, round(sqrt(sum((y-b*x)*(y-b*x)) / (any_value(n) - any_value(l) - 1) / any_value(xx)), 6) AS std_error FROM f, k""")
def _(t):
    return regression.regress("l_extendedprice ~ l_quantity | l_suppkey", t.lineitem).frame(t.spark).select("term", "estimate", "std_error")


PANEL = "SELECT l_suppkey AS i, year(l_shipdate) AS t, avg(l_extendedprice) AS y, avg(l_quantity) AS x, CASE l_suppkey % 3 WHEN 1 THEN 1998 WHEN 2 THEN 2000 END AS g FROM lineitem GROUP BY 1, 2"


def _panel(t: Tables):
    first = F.when(F.col("i") % 3 == 1, 1998).when(F.col("i") % 3 == 2, 2000)
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("i"), F.year("l_shipdate").alias("t")).agg(F.avg("l_extendedprice").alias("y"), F.avg("l_quantity").alias("x"))
    return p.withColumn("g", first).withColumn("d", F.coalesce(F.col("t") >= F.col("g"), F.lit(False)).cast("double"))


@query("feols_twoway", f"""WITH p AS ({PANEL}), d AS (SELECT y - avg(y) OVER (PARTITION BY i) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y, x - avg(x) OVER (PARTITION BY i) - avg(x) OVER (PARTITION BY t) + avg(x) OVER () AS x FROM p)
SELECT 'x' AS term, round(sum(x*y)/sum(x*x), 4) AS estimate FROM d""", 4)
def _(t):
    return regression.regress("y ~ x | i + t", _panel(t)).frame(t.spark).select("term", "estimate")


@query("panel_between", f"WITH m AS (SELECT i, avg(y) y, avg(x) x FROM ({PANEL}) GROUP BY i) SELECT 'x' AS term, round(regr_slope(y, x), 5) AS estimate FROM m", 5)
def _(t):
    return panel.between(_panel(t), "y", ["x"], "i").frame(t.spark).where("term = 'x'").select("term", "estimate")


@query("panel_first_difference", f"WITH d AS (SELECT y - lag(y) OVER w AS y, x - lag(x) OVER w AS x FROM ({PANEL}) WINDOW w AS (PARTITION BY i ORDER BY t)) SELECT 'x' AS term, round(sum(x*y)/sum(x*x), 5) AS estimate FROM d WHERE y IS NOT NULL", 5)
def _(t):
    return panel.first_difference(_panel(t), "y", ["x"], "i", "t").frame(t.spark).select("term", "estimate")


@query("panel_random_effects")
def _(t):
    return _slopes(panel.random_effects(_panel(t), "y", ["x"], "i"), t)


@query("panel_mundlak", f"WITH d AS (SELECT y, x, avg(x) OVER w AS m, y - avg(y) OVER w AS yw, x - avg(x) OVER w AS xw FROM ({PANEL}) WINDOW w AS (PARTITION BY i)), k AS (SELECT sum(xw*yw)/sum(xw*xw) b, covar_pop(m, y)/var_pop(m) g FROM d) SELECT 'x' AS term, round(b, 5) AS estimate FROM k UNION ALL SELECT 'mean_x', round(g - b, 5) FROM k", 5)
def _(t):
    return _slopes(panel.mundlak(_panel(t), "y", ["x"], "i"), t).select("term", "estimate")


BINARY = "SELECT (l_returnflag = 'R')::INT AS y, (l_quantity > 25)::INT AS x FROM lineitem"


def _binary(t: Tables):
    return t.lineitem.select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") > 25).cast("double").alias("x"))


@query("logit", f"WITH c AS (SELECT sum(x*y) a, sum(x*(1-y)) b, sum((1-x)*y) c, sum((1-x)*(1-y)) d FROM ({BINARY})) SELECT 'x' AS term, round(ln(a*d/(b*c)), 6) AS estimate, round(sqrt(1/a+1/b+1/c+1/d), 6) AS std_error FROM c")
def _(t):
    return _slopes(regression.glm(_binary(t), "y", ["x"], family="logit"), t)


@query("cloglog", f"WITH c AS (SELECT avg(y) FILTER (x = 1) p, avg(y) FILTER (x = 0) q FROM ({BINARY})) SELECT 'x' AS term, round(ln(-ln(1-p)) - ln(-ln(1-q)), 6) AS estimate FROM c")
def _(t):
    return _slopes(regression.glm(_binary(t), "y", ["x"], family="cloglog"), t).select("term", "estimate")


@query("probit")
def _(t):
    return _slopes(regression.glm(_binary(t), "y", ["x"], family="probit"), t)


@query("poisson", "WITH c AS (SELECT sum(l_linenumber) FILTER (l_quantity > 25) a, count(*) FILTER (l_quantity > 25) n, sum(l_linenumber) FILTER (l_quantity <= 25) b, count(*) FILTER (l_quantity <= 25) m FROM lineitem) SELECT 'x' AS term, round(ln((a/n)/(b/m)), 6) AS estimate, round(sqrt(1/a + 1/b), 6) AS std_error FROM c")
def _(t):
    d = t.lineitem.select(F.col("l_linenumber").alias("y"), (F.col("l_quantity") > 25).cast("double").alias("x"))
    return _slopes(regression.glm(d, "y", ["x"], family="poisson"), t)


@query("gamma_glm", "SELECT 'x' AS term, round(ln(avg(o_totalprice) FILTER (o_orderstatus = 'F') / avg(o_totalprice) FILTER (o_orderstatus <> 'F')), 6) AS estimate FROM orders")
def _(t):
    d = t.orders.select(F.col("o_totalprice").alias("y"), (F.col("o_orderstatus") == "F").cast("double").alias("x"))
    return _slopes(regression.glm(d, "y", ["x"], family="gamma"), t).select("term", "estimate")


@query("logit_margins", f"WITH c AS (SELECT avg(y) FILTER (x = 1) p, avg(y) FILTER (x = 0) q, avg(x) m FROM ({BINARY})) SELECT 'x' AS term, round((ln(p/(1-p)) - ln(q/(1-q))) * (m*p*(1-p) + (1-m)*q*(1-q)), 6) AS effect FROM c")
def _(t):
    d = _binary(t)
    m = regression.margins(regression.glm(d, "y", ["x"]), d, ["x"])
    return t.spark.createDataFrame([(n, e) for n, e, _ in m], "term string, effect double")


IV = "SELECT l_extendedprice AS y, l_quantity AS d, p_size AS z FROM lineitem JOIN part ON l_partkey = p_partkey"


def _iv(t: Tables):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("d"), F.col("p_size").alias("z"), F.col("l_linenumber").alias("z2"))


@query("iv_2sls", f"WITH d AS ({IV}), k AS (SELECT covar_pop(y, z)/covar_pop(d, z) b, avg(y) my, avg(d) md, avg(z) mz, covar_pop(d, z) dz, var_pop(z) zz, count(*) n FROM d) SELECT 'd' AS term, round(any_value(b), 4) AS estimate, round(sqrt(sum((y-my-b*(d-md))*(y-my-b*(d-md))) / (any_value(n)-2) * any_value(zz) / (any_value(n) * any_value(dz) * any_value(dz))), 4) AS std_error FROM d, k", 4)
def _(t):
    return _slopes(regression.iv(_iv(t), "y", ["d"], ["z"]), t)


@query("iv_first_stage", f"WITH d AS ({IV}) SELECT round(regr_r2(d, z) / (1 - regr_r2(d, z)) * (count(*) - 2), 6) AS f FROM d")
def _(t):
    return one(t.spark, {"f": regression.iv(_iv(t), "y", ["d"], ["z"]).extra["first_stage_f"][0]})


@query("iv_anderson_rubin", f"WITH d AS ({IV}) SELECT round(regr_r2(y, z) / (1 - regr_r2(y, z)) * (count(*) - 2), 6) AS f FROM d")
def _(t):
    return one(t.spark, {"f": regression.anderson_rubin(_iv(t), "y", "d", ["z"])[0]})


@query("iv_liml")
def _(t):
    return _slopes(regression.iv(_iv(t), "y", ["d"], ["z", "z2"], method="liml"), t)


@query("iv_fuller")
def _(t):
    return _slopes(regression.iv(_iv(t), "y", ["d"], ["z", "z2"], method="fuller"), t)


@query("breusch_pagan", """WITH d AS (SELECT l_extendedprice y, l_quantity x FROM lineitem), k AS (SELECT regr_slope(y, x) b, regr_intercept(y, x) a FROM d), e AS (SELECT x, (y-a-b*x)*(y-a-b*x) AS q FROM d, k)
SELECT round(count(*) * regr_r2(q, x), 5) AS lm FROM e""", 5)
def _(t):
    return one(t.spark, {"lm": regression.breusch_pagan(t.lineitem, "l_extendedprice", ["l_quantity"])[0]})


@query("white_test")
def _(t):
    return one(t.spark, dict(zip(("lm", "p"), regression.white_test(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"]))))


@query("reset_test")
def _(t):
    return one(t.spark, dict(zip(("f", "p"), regression.reset_test(t.lineitem, "l_extendedprice", ["l_quantity"]))))


@query("vif", "SELECT 'l_quantity' AS term, round(1/(1-regr_r2(l_quantity, l_discount)), 8) AS vif FROM lineitem UNION ALL SELECT 'l_discount', round(1/(1-regr_r2(l_discount, l_quantity)), 8) FROM lineitem", 8)
def _(t):
    return t.spark.createDataFrame(list(regression.vif(t.lineitem, ["l_quantity", "l_discount"]).items()), "term string, vif double")


@query("jarque_bera", """WITH m AS (SELECT avg(o_totalprice) m, count(*) n FROM orders), s AS (SELECT avg(power(o_totalprice - m, 2)) m2, avg(power(o_totalprice - m, 3)) m3, avg(power(o_totalprice - m, 4)) m4, any_value(n) n FROM orders, m)
SELECT round(n/6*(power(m3/power(m2, 1.5), 2) + power(m4/(m2*m2) - 3, 2)/4), 5) AS jb FROM s""", 5)
def _(t):
    return one(t.spark, {"jb": regression.jarque_bera(t.orders, "o_totalprice")[0]})


@query("durbin_watson", f"""WITH p AS ({PANEL}), k AS (SELECT regr_slope(y, x) b, regr_intercept(y, x) a FROM p), e AS (SELECT i, t, y-a-b*x AS e FROM p, k), d AS (SELECT e, e - lag(e) OVER (PARTITION BY i ORDER BY t) AS f FROM e)
SELECT round(sum(f*f)/sum(e*e), 6) AS dw FROM d""")
def _(t):
    return one(t.spark, {"dw": regression.durbin_watson(_panel(t), "y", ["x"], "t", "i")})


@query("did_2x2", """WITH c AS (SELECT l_returnflag = 'R' d, l_shipdate >= TIMESTAMP '1998-06-01' t, avg(l_extendedprice) m, var_pop(l_extendedprice) v, count(*) n FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY 1, 2)
SELECT 'did' AS term, round(sum(CASE WHEN d = t THEN m ELSE -m END), 4) AS estimate, round(sqrt(sum(v/n) * sum(n) / (sum(n) - 4)), 4) AS std_error FROM c""", 4)
def _(t):
    d = t.lineitem.where(F.col("l_returnflag").isin("R", "N")).select("l_extendedprice", "l_returnflag", (F.col("l_shipdate") >= "1998-06-01").cast("int").alias("post"))
    return did.did_2x2(d, "l_extendedprice", "l_returnflag", "post", vcov="HC1").frame(t.spark).where("term = 'did'").select("term", "estimate", "std_error")


@query("ddd", """WITH c AS (SELECT l_returnflag = 'R' d, l_shipdate >= TIMESTAMP '1998-06-01' t, l_linestatus = 'O' s, avg(l_extendedprice) m FROM lineitem GROUP BY 1, 2, 3)
SELECT 'ddd' AS term, round(sum(m * (2*d::INT-1) * (2*t::INT-1) * (2*s::INT-1)), 4) AS estimate FROM c""", 4)
def _(t):
    d = t.lineitem.select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("d"), (F.col("l_shipdate") >= "1998-06-01").cast("int").alias("t"), (F.col("l_linestatus") == "O").cast("int").alias("s"))
    return did.ddd(d, "l_extendedprice", "d", "t", "s").frame(t.spark).where("term = 'ddd'").select("term", "estimate")


CELLS = f"""p AS ({PANEL}), pr AS (SELECT DISTINCT a.g, b.t, a.g - 1 AS base FROM (SELECT DISTINCT g FROM p WHERE g IS NOT NULL) a, (SELECT DISTINCT t FROM p) b WHERE b.t <> a.g - 1),
lg AS (SELECT pr.g AS cohort, pr.t, x.y - o.y AS dy, (x.g IS NOT NULL) AS tr FROM pr JOIN p x ON x.t = pr.t AND (x.g = pr.g OR x.g IS NULL) JOIN p o ON o.i = x.i AND o.t = pr.base),
ce AS (SELECT cohort::DOUBLE AS "group", t::DOUBLE AS "time", avg(dy) FILTER (tr) - avg(dy) FILTER (NOT tr) AS att, sqrt(var_pop(dy) FILTER (tr) / count(*) FILTER (tr) + var_pop(dy) FILTER (NOT tr) / count(*) FILTER (NOT tr)) AS std_error, count(*) FILTER (tr) AS n_treated, count(*) FILTER (NOT tr) AS n_control FROM lg GROUP BY 1, 2)"""


@query("did_att_gt", f'WITH {CELLS} SELECT "group", "time", round(att, 4) AS att, round(std_error, 4) AS std_error, n_treated, n_control FROM ce', 4)
def _(t):
    return did.att_gt(_panel(t), "y", "g", "i", "t")


@query("did_att_simple", f"WITH {CELLS} SELECT 'simple' AS level, round(sum(att*n_treated)/sum(n_treated), 4) AS att FROM ce WHERE \"time\" >= \"group\"", 4)
def _(t):
    return did.aggte(did.att_gt(_panel(t), "y", "g", "i", "t"), "simple")


@query("did_att_group", f"WITH {CELLS} SELECT \"group\"::VARCHAR AS level, round(avg(att), 4) AS att FROM ce WHERE \"time\" >= \"group\" GROUP BY 1", 4)
def _(t):
    return did.aggte(did.att_gt(_panel(t), "y", "g", "i", "t"), "group")


@query("did_att_dynamic", f"WITH {CELLS} SELECT (\"time\" - \"group\")::VARCHAR AS level, round(sum(att*n_treated)/sum(n_treated), 4) AS att FROM ce GROUP BY 1", 4)
def _(t):
    return did.aggte(did.att_gt(_panel(t), "y", "g", "i", "t"), "dynamic")


@query("did_att_calendar", f"WITH {CELLS} SELECT \"time\"::VARCHAR AS level, round(sum(att*n_treated)/sum(n_treated), 4) AS att FROM ce WHERE \"time\" >= \"group\" GROUP BY 1", 4)
def _(t):
    return did.aggte(did.att_gt(_panel(t), "y", "g", "i", "t"), "calendar")


LATER = CELLS.replace("(x.g = pr.g OR x.g IS NULL)", "(x.g = pr.g OR x.g IS NULL OR x.g > greatest(pr.t, pr.base))").replace("(x.g IS NOT NULL) AS tr", "coalesce(x.g = pr.g, false) AS tr")


@query("did_notyettreated", f'WITH {LATER} SELECT "group", "time", round(att, 4) AS att, round(std_error, 4) AS std_error, n_treated, n_control FROM ce', 4)
def _(t):
    return did.att_gt(_panel(t), "y", "g", "i", "t", control="notyettreated")


@query("did_bacon")
def _(t):
    p = _panel(t)
    periods = p.select("t").distinct().count()
    full = p.groupBy("i").count().where(F.col("count") == periods)  # the decomposition needs a balanced panel
    return did.bacon(p.join(full, "i", "left_semi"), "y", "g", "i", "t")


TWO_WAY = """avg({c}) OVER (PARTITION BY i) - avg({c}) OVER (PARTITION BY t) + avg({c}) OVER ()"""


@query("did_twfe", f"""WITH p AS (SELECT *, (g IS NOT NULL AND t >= g)::INT::DOUBLE AS d FROM ({PANEL})), w AS (SELECT i, t, y - {TWO_WAY.format(c='y')} AS y, d - {TWO_WAY.format(c='d')} AS d FROM p), k AS (SELECT sum(d*y)/sum(d*d) b, sum(d*d) dd, count(*) n, count(DISTINCT t) p FROM w),
c AS (SELECT i, sum(d*(y - b*d)) s FROM w, k GROUP BY i) SELECT 'd' AS term, round(any_value(b), 4) AS estimate, round(sqrt(sum(s*s)*count(*)/(count(*) - 1.0)*any_value((n - 1.0)/(n - p - 1)))/any_value(dd), 4) AS std_error FROM c, k""", 4)
def _(t):
    return did.twfe(_panel(t), "y", "d", "i", "t").frame(t.spark).select("term", "estimate", "std_error")


@query("did_event_study")
def _(t):
    return did.event_study(_panel(t), "y", "g", "i", "t").frame(t.spark).select("term", "estimate", "std_error")


@query("did_stacked")
def _(t):
    f = did.stacked(_panel(t), "y", "g", "i", "t", (-2, 1))
    return one(t.spark, {"att": f.extra["att"], "std_error": f.extra["att_se"]})


@query("did_sun_abraham")
def _(t):
    return did.sun_abraham(_panel(t), "y", "g", "i", "t")


@query("did_imputation")
def _(t):
    return did.imputation(_panel(t), "y", "g", "i", "t")


@query("oaxaca", """WITH d AS (SELECT l_extendedprice y, l_quantity x, l_returnflag = 'R' g FROM lineitem WHERE l_returnflag IN ('R', 'N')),
k AS (SELECT avg(x) FILTER (NOT g) x0, avg(x) FILTER (g) x1, regr_slope(y, x) FILTER (NOT g) b0, regr_intercept(y, x) FILTER (NOT g) a0, regr_slope(y, x) FILTER (g) b1, regr_intercept(y, x) FILTER (g) a1 FROM d)
SELECT 'x' AS term, round((x0-x1)*b0, 4) AS explained, round(x1*(b0-b1), 4) AS unexplained FROM k UNION ALL SELECT 'Intercept', 0.0, round(a0-a1, 4) FROM k UNION ALL SELECT 'total', round((x0-x1)*b0, 4), round(a0-a1+x1*(b0-b1), 4) FROM k""", 4)
def _(t):
    d = t.lineitem.where(F.col("l_returnflag").isin("R", "N")).select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), (F.col("l_returnflag") == "R").cast("double").alias("g"))
    return inequality.oaxaca(d, "y", ["x"], "g")


@query("kitagawa", """WITH d AS (SELECT l_discount y, l_linenumber c, (l_returnflag = 'R')::INT g FROM lineitem), t AS (SELECT sum(1-g) n0, sum(g) n1 FROM d),
p AS (SELECT c, sum(1-g)/any_value(n0) s0, sum(g)/any_value(n1) s1, avg(y) FILTER (g = 0) r0, avg(y) FILTER (g = 1) r1 FROM d, t GROUP BY c)
SELECT round(sum((r1-r0)*(s0+s1)/2), 8) AS rate_effect, round(sum((s1-s0)*(r0+r1)/2), 8) AS composition_effect, round(sum(s1*r1)-sum(s0*r0), 8) AS gap FROM p""", 8)
def _(t):
    return inequality.kitagawa(t.lineitem.withColumn("g", (F.col("l_returnflag") == "R").cast("int")), "l_discount", "l_linenumber", "g")


@query("gelbach", """WITH d AS (SELECT l_extendedprice y, l_quantity a, l_discount b FROM lineitem), s AS (SELECT covar_pop(a,b) ab, var_pop(a) aa, var_pop(b) bb, covar_pop(a,y) ay, covar_pop(b,y) yb FROM d)
SELECT 'b' AS term, round(ab/aa*(aa*yb-ab*ay)/(aa*bb-ab*ab), 6) AS contribution FROM s UNION ALL SELECT 'total', round(ay/aa - (bb*ay-ab*yb)/(aa*bb-ab*ab), 6) FROM s""")
def _(t):
    return inequality.gelbach(_line(t), "y", "a", ["b"])


@query("rif_quantile")
def _(t):
    return _slopes(inequality.rif_regression(t.lineitem, "l_extendedprice", ["l_quantity"], 0.5, vcov="HC1"), t)


@query("dfl")
def _(t):
    return inequality.dfl(_line(t).withColumn("r", (F.col("g") % 2).cast("double")), "y", ["a", "b"], "r")


@query("lasso")
def _(t):
    return t.spark.createDataFrame(list(learn.elastic_net(_line(t), "y", ["a", "b", "w"], 50.0).items()), "term string, estimate double")


@query("ridge")
def _(t):
    return t.spark.createDataFrame(list(learn.ridge(_line(t), "y", ["a", "b", "w"], 0.1).items()), "term string, estimate double")


@query("rigorous_lasso")
def _(t):
    return t.spark.createDataFrame(list(learn.rigorous_lasso(_line(t), "y", ["a", "b", "w"]).items()), "term string, estimate double")


@query("double_selection")
def _(t):
    return _slopes(learn.double_selection(_line(t), "y", "a", ["b", "w"]), t)


@query("pca", "SELECT round((1 + abs(corr(l_quantity, l_extendedprice))) / 2, 8) AS first FROM lineitem", 8)
def _(t):
    return one(t.spark, {"first": learn.pca(t.lineitem, ["l_quantity", "l_extendedprice"])[0][0]})


@query("pc_skeleton")
def _(t):
    return t.spark.createDataFrame(learn.pc_skeleton(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "a string, b string")


@query("conformal")
def _(t):
    fit, width = learn.conformal(t.lineitem, "l_extendedprice", ["l_quantity"], "l_orderkey")
    return one(t.spark, {"slope": fit["l_quantity"], "half_width": width})


@query("wild_cluster")
def _(t):
    return one(t.spark, resample.wild_cluster(_line(t), "y", ["a", "b"], "a", "g", 199))
