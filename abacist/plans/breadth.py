"""Queries of classical tests, tables and imputation, weighting and distributional effects, and more of survival, epidemiology and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.operators import causal, epi, graph, survival
from abacist.operators import hypothesis as H
from abacist.operators import tabulate as T
from abacist.operators import weighting as W
from abacist.plans.graphs import PAIRS, UNDIRECTED, _edges, _pairs
from abacist.plans.models import PANEL, _panel
from abacist.plans.registry import Tables, one, query

LINE = "SELECT l_orderkey k, l_extendedprice y, l_quantity x, l_discount z, l_returnflag f, (l_returnflag = 'R')::INT t, l_linenumber c, (l_linestatus = 'O')::INT s, (l_quantity > 25)::INT b FROM lineitem"


def _line(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("z"), F.col("l_returnflag").alias("f"), (F.col("l_returnflag") == "R").cast("int").alias("t"), F.col("l_linenumber").alias("c"), (F.col("l_linestatus") == "O").cast("int").alias("s"), (F.col("l_quantity") > 25).cast("int").alias("b"))


# ---------------------------------------------------------------- classical tests
ARMS = f"SELECT t g, count(*)::DOUBLE n, avg(y) m, var_samp(y) v FROM ({LINE}) GROUP BY 1"


@query("t_test", f"WITH a AS ({ARMS}) SELECT round(p.m - q.m, 4) AS difference, round(sqrt(p.v/p.n + q.v/q.n), 4) AS std_error, round((p.m - q.m)/sqrt(p.v/p.n + q.v/q.n), 4) AS t, round(power(p.v/p.n + q.v/q.n, 2)/(power(p.v/p.n, 2)/(p.n-1) + power(q.v/q.n, 2)/(q.n-1)), 4) AS df FROM a p, a q WHERE p.g = 1 AND q.g = 0", 4)
def _(t):
    r = H.t_test(_line(t), "y", "t")
    return one(t.spark, {k: r[k] for k in ("difference", "std_error", "t", "df")})


@query("t_test_pooled", f"WITH a AS ({ARMS}), s AS (SELECT sum((n-1)*v)/(sum(n)-2) s2, sum(1/n) h FROM a) SELECT round((SELECT m FROM a WHERE g = 1) - (SELECT m FROM a WHERE g = 0), 4) AS difference, round(sqrt(s2*h), 4) AS std_error FROM s", 4)
def _(t):
    r = H.t_test(_line(t), "y", "t", True)
    return one(t.spark, {k: r[k] for k in ("difference", "std_error")})


ANOVA = "n AS (SELECT g, count(*)::DOUBLE n, avg(y) m, var_samp(y) v FROM d GROUP BY 1), s AS (SELECT sum(n*m)/sum(n) mm, sum(n) n, count(*) k FROM n), q AS (SELECT sum(n.n*power(n.m - mm, 2)) bb, sum((n.n-1)*n.v) ww, any_value(s.n) n, any_value(k) k FROM n, s) SELECT round(bb/(k-1)/(ww/(n-k)), 8) AS f, round(bb/(bb+ww), 8) AS eta_squared FROM q"


@query("anova", f"WITH d AS (SELECT y, f g FROM ({LINE})), {ANOVA}", 8)
def _(t):
    r = H.anova(_line(t), "y", "f")
    return one(t.spark, {k: r[k] for k in ("f", "eta_squared")})


@query("levene", f"WITH d AS (SELECT abs(y - avg(y) OVER (PARTITION BY f)) y, f g FROM ({LINE})), {ANOVA}", 8)
def _(t):
    r = H.levene(_line(t), "y", "f")
    return one(t.spark, {k: r[k] for k in ("f", "eta_squared")})


@query("bartlett", f"WITH a AS (SELECT count(*)::DOUBLE n, var_samp(y) v FROM ({LINE}) GROUP BY f), s AS (SELECT sum(n) n, count(*) k, sum((n-1)*v)/(sum(n)-count(*)) p, sum((n-1)*ln(v)) l, sum(1/(n-1)) h FROM a) SELECT round(((n-k)*ln(p) - l)/(1 + (h - 1/(n-k))/(3*(k-1))), 6) AS chi2 FROM s")
def _(t):
    return one(t.spark, {"chi2": H.bartlett(_line(t), "y", "f")["chi2"]})


RANKED = "SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1)/2.0::DOUBLE AS r FROM"


@query("kruskal", f"WITH d AS ({RANKED} ({LINE})), g AS (SELECT count(*)::DOUBLE n, sum(r) r FROM d GROUP BY f), t AS (SELECT sum(power(m, 3) - m) t FROM (SELECT count(*)::DOUBLE m FROM d GROUP BY y)), n AS (SELECT sum(n) n, sum(r*r/n) s FROM g) SELECT round((12/(n*(n+1))*s - 3*(n+1))/(1 - t/(power(n, 3) - n)), 5) AS h FROM n, t", 5)
def _(t):
    return one(t.spark, {"h": H.kruskal(_line(t), "y", "f")["h"]})


@query("rank_sum", f"WITH d AS ({RANKED} ({LINE})), n AS (SELECT sum(t)::DOUBLE b, sum(1-t)::DOUBLE a, sum(r*t) r FROM d), h AS (SELECT sum(power(m, 3) - m) h FROM (SELECT count(*)::DOUBLE m FROM d GROUP BY y)) SELECT round(r - b*(b+1)/2, 3) AS u, round((r - b*(b+1)/2 - a*b/2)/sqrt(a*b/12*(a+b+1 - h/((a+b)*(a+b-1)))), 6) AS z FROM n, h")
def _(t):
    r = H.rank_sum(_line(t), "y", "t")
    return one(t.spark, {"u": r["u"], "z": r["z"]}).select(F.round("u", 3).alias("u"), "z")


@query("kolmogorov_smirnov", f"WITH d AS (SELECT y, sum(t)::DOUBLE b, sum(1-t)::DOUBLE a FROM ({LINE}) GROUP BY 1) SELECT round(max(abs(ra/ta - rb/tb)), 8) AS d FROM (SELECT sum(a) OVER w ra, sum(b) OVER w rb, sum(a) OVER () ta, sum(b) OVER () tb FROM d WINDOW w AS (ORDER BY y))", 8)
def _(t):
    return one(t.spark, {"d": H.kolmogorov_smirnov(_line(t), "y", "t")["d"]})


@query("spearman", f"SELECT round(corr(rx, ry), 8) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1)/2.0::DOUBLE rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1)/2.0::DOUBLE ry FROM ({LINE}))", 8)
def _(t):
    return one(t.spark, {"rho": H.spearman(_line(t), "x", "y")["rho"]})


@query("mcnemar", f"SELECT round(power(abs(p-q) - 1, 2)/(p+q), 6) AS chi2, round(p/q, 6) AS odds_ratio FROM (SELECT sum(t*(1-s))::DOUBLE p, sum((1-t)*s)::DOUBLE q FROM ({LINE}))")
def _(t):
    r = H.mcnemar(_line(t), "t", "s")
    return one(t.spark, {k: r[k] for k in ("chi2", "odds_ratio")})


@query("trend_test", f"SELECT round(covar_pop(c, t)*sqrt(count(*)/(avg(t)*(1-avg(t))*var_pop(c))), 6) AS z FROM ({LINE})")
def _(t):
    return one(t.spark, {"z": H.trend(_line(t), "t", "c")["z"]})


# ---------------------------------------------------------------- tables and imputation
GAPS = "SELECT l_orderkey k, l_linenumber c, l_returnflag f, nullif(l_discount, 0) z, nullif(l_tax, 0) w FROM lineitem"


def _gaps(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("c"), F.col("l_returnflag").alias("f"), F.expr("nullif(l_discount, 0)").alias("z"), F.expr("nullif(l_tax, 0)").alias("w"))


@query("missing_table", " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS present, count(*) - count({c}) AS missing, round((count(*) - count({c}))/count(*), 8) AS share FROM ({GAPS})" for c in "zw"), 8)
def _(t):
    return T.missing_table(_gaps(t), ["z", "w"])


@query("missing_patterns", f"SELECT CASE WHEN z IS NULL THEN '.' ELSE '+' END || CASE WHEN w IS NULL THEN '.' ELSE '+' END AS pattern, count(*) AS n FROM ({GAPS}) GROUP BY 1")
def _(t):
    return T.missing_patterns(_gaps(t), ["z", "w"])


@query("codebook", "SELECT 'o_orderstatus' AS variable, 'string' AS type, count(DISTINCT o_orderstatus) AS distinct, min(o_orderstatus) AS least, max(o_orderstatus) AS most FROM orders UNION ALL SELECT 'o_custkey', 'bigint', count(DISTINCT o_custkey), min(o_custkey)::VARCHAR, max(o_custkey)::VARCHAR FROM orders")
def _(t):
    return T.codebook(t.orders, ["o_orderstatus", "o_custkey"])


@query("duplicates", "SELECT copies, count(*) AS keys, sum(copies - 1)::BIGINT AS surplus FROM (SELECT count(*) AS copies FROM lineitem GROUP BY l_partkey, l_suppkey) GROUP BY 1")
def _(t):
    return T.duplicates(t.lineitem, ["l_partkey", "l_suppkey"])


@query("panel_describe", f"WITH p AS (SELECT i, count(*) n, count(DISTINCT t) t FROM ({PANEL}) GROUP BY 1), k AS (SELECT count(DISTINCT t) k FROM ({PANEL})) SELECT count(*) AS units, sum(n)::BIGINT AS rows, min(t) AS least, max(t) AS most, round(avg(t), 6) AS mean, any_value(k) AS periods, min(t) = any_value(k) AND sum(n - t) = 0 AS balanced FROM p, k")
def _(t):
    return T.panel_describe(_panel(t), "i", "t").drop("repeated").select("units", "rows", "least", "most", "mean", "periods", "balanced")


@query("within_between", f"WITH d AS (SELECT i, y FROM ({PANEL})), m AS (SELECT i, avg(y) m FROM d GROUP BY 1) SELECT round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS overall, (SELECT round(stddev_samp(m), 4) FROM m) AS between, round(sqrt(sum(power(y - m, 2))/(count(*) - 1)), 4) AS within FROM d JOIN m USING (i)", 4)
def _(t):
    return T.within_between(_panel(t), "y", "i")


@query("fill_in", "WITH e AS (SELECT DISTINCT user_id, event_type FROM events) SELECT u.user_id, k.event_type, e.user_id IS NULL AS _filled FROM (SELECT DISTINCT user_id FROM e) u CROSS JOIN (SELECT DISTINCT event_type FROM e) k LEFT JOIN e ON e.user_id = u.user_id AND e.event_type = k.event_type")
def _(t):
    return T.fill_in(t.events.select("user_id", "event_type").distinct(), "user_id", "event_type")


@query("margins", f"SELECT coalesce(f, 'Total') AS \"row\", coalesce(c::VARCHAR, 'Total') AS \"column\", count(*) AS n FROM ({LINE}) GROUP BY CUBE (f, c)")
def _(t):
    return T.margins(_line(t), "f", "c")


@query("pivot", f"SELECT c, round(avg(y) FILTER (f = 'A'), 4) AS A, round(avg(y) FILTER (f = 'N'), 4) AS N, round(avg(y) FILTER (f = 'R'), 4) AS R FROM ({LINE}) GROUP BY 1", 4)
def _(t):
    return T.pivot(_line(t), "c", "f", "y", ["A", "N", "R"])


@query("longer", f"SELECT k, c, 'x' AS variable, x AS value FROM ({LINE}) UNION ALL SELECT k, c, 'z', z FROM ({LINE})")
def _(t):
    return T.longer(_line(t), ["k", "c"], ["x", "z"])


@query("standardise", f"SELECT k, c, round((y - avg(y) OVER w)/stddev_samp(y) OVER w, 6) AS z_y FROM ({LINE}) WINDOW w AS (PARTITION BY f)")
def _(t):
    return T.standardise(_line(t), ["y"], ["f"]).select("k", "c", "z_y")


@query("cut", f"SELECT (CASE WHEN x > 0 AND x <= 10 THEN 1 WHEN x > 10 AND x <= 30 THEN 2 WHEN x > 30 AND x <= 50 THEN 3 END)::INT AS bin, count(*) AS n FROM ({LINE}) GROUP BY 1")
def _(t):
    return _line(t).groupBy(T.cut("x", [0, 10, 30, 50]).alias("bin")).agg(F.count("*").alias("n"))


@query("quantile_groups", f"WITH q AS (SELECT quantile_cont(y, [0.25, 0.5, 0.75]) q FROM ({LINE})) SELECT (1 + (y > q[1])::INT + (y > q[2])::INT + (y > q[3])::INT)::INT AS quantile, count(*) AS n FROM ({LINE}), q GROUP BY 1")
def _(t):
    return T.quantile_groups(_line(t), "y", 4).groupBy("quantile").agg(F.count("*").alias("n"))


@query("dummies", f"SELECT k, c, (f = 'N')::INT AS \"f_N\", (f = 'R')::INT AS \"f_R\" FROM ({LINE})")
def _(t):
    return T.dummies(_line(t), "f", ["A", "N", "R"]).select("k", "c", "f_N", "f_R")


@query("impute_mean", f"SELECT k, c, round(coalesce(z, avg(z) OVER (PARTITION BY f)), 8) AS z FROM ({GAPS})", 8)
def _(t):
    return T.impute(_gaps(t), ["z"], "mean", ["f"]).select("k", "c", "z")


@query("impute_median", f"SELECT k, c, round(coalesce(z, median(z) OVER (PARTITION BY f)), 8) AS z FROM ({GAPS})", 8)
def _(t):
    return T.impute(_gaps(t), ["z"], "median", ["f"]).select("k", "c", "z")


@query("carry_forward", "SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events")
def _(t):
    gaps = t.events.withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return T.carry_forward(gaps, ["value"], "user_id", "event_id").select("event_id", "value")


@query("hot_deck")
def _(t):
    return T.hot_deck(_gaps(t), "z", ["f"], ["k", "c"]).groupBy("f").agg(F.count("z").alias("n"), F.avg("z").alias("z"))


# ---------------------------------------------------------------- weighting and distributions
CELLS = f"d AS ({LINE}), n AS (SELECT c, b, f, count(*)::DOUBLE n FROM d GROUP BY 1, 2, 3), a AS (SELECT c, b, sum(n) al, count(*) arms FROM n GROUP BY 1, 2), w AS (SELECT d.*, al/n.n AS w FROM d JOIN n USING (c, b, f) JOIN a USING (c, b) WHERE arms = (SELECT count(DISTINCT f) FROM d))"


@query("multi_arm", f"WITH {CELLS}, m AS (SELECT f, sum(w*y)/sum(w) m, sum(w) tw, count(*) n FROM w GROUP BY 1) SELECT f AS arm, round(any_value(m), 4) AS mean, round(sqrt(sum(power(w*(y-m)/tw, 2))), 4) AS std_error, any_value(n) AS n FROM w JOIN m USING (f) GROUP BY 1", 4)
def _(t):
    return W.multi_arm(_line(t), "y", "f", ["c", "b"])


WQ = "v AS (SELECT g, y, sum(w) w FROM wd GROUP BY 1, 2), s AS (SELECT g, y, round(sum(w) OVER (PARTITION BY g ORDER BY y)/sum(w) OVER (PARTITION BY g), 12) p FROM v)"


@query("weighted_quantiles", f"WITH wd AS (SELECT f g, y, x w FROM ({LINE})), {WQ} SELECT g AS f, q AS quantile, min(y) FILTER (p >= q) AS value FROM s, (VALUES (0.1::DOUBLE), (0.5), (0.9)) k(q) GROUP BY 1, 2")
def _(t):
    return W.weighted_quantiles(_line(t), "y", "x", [0.1, 0.5, 0.9], ["f"])


@query("quantile_effects", f"WITH d AS ({LINE}), n AS (SELECT c, b, t, count(*)::DOUBLE n FROM d GROUP BY 1, 2, 3), a AS (SELECT c, b, sum(n) al, count(*) arms FROM n GROUP BY 1, 2), wd AS (SELECT d.t g, y, al/n.n AS w FROM d JOIN n USING (c, b, t) JOIN a USING (c, b) WHERE arms = 2), {WQ}, q AS (SELECT g, q, min(y) FILTER (p >= q) v FROM s, (VALUES (0.25::DOUBLE), (0.5), (0.75)) k(q) GROUP BY 1, 2) SELECT q AS quantile, max(v) FILTER (g = 1) AS treated, max(v) FILTER (g = 0) AS control, round(max(v) FILTER (g = 1) - max(v) FILTER (g = 0), 6) AS effect FROM q GROUP BY 1")
def _(t):
    return W.quantile_effects(_line(t), "y", "t", ["c", "b"])


CEM = f"d AS ({LINE}), e AS (SELECT c, b, s, count(*) FILTER (t = 1)::DOUBLE n1, count(*) FILTER (t = 0)::DOUBLE n0, avg(y) FILTER (t = 1) m1, avg(y) FILTER (t = 0) m0, coalesce(var_samp(y) FILTER (t = 1), 0) v1, coalesce(var_samp(y) FILTER (t = 0), 0) v0 FROM d GROUP BY 1, 2, 3)"


@query("coarsened_matching", f"WITH {CEM} SELECT round(sum(n1*(m1-m0))/sum(n1), 4) AS att, round(sqrt(sum(n1*n1*(v1/n1+v0/n0)))/sum(n1), 4) AS std_error, count(*)::DOUBLE AS cells FROM e WHERE n1 > 0 AND n0 > 0", 4)
def _(t):
    r = W.coarsened_matching(_line(t), "y", "t", ["c", "b", "s"])
    return one(t.spark, {k: r[k] for k in ("att", "std_error", "cells")})


@query("subclassification", f"WITH q AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) q FROM ({LINE})), d AS (SELECT y, t, (x > q[1])::INT + (x > q[2])::INT + (x > q[3])::INT + (x > q[4])::INT k FROM ({LINE}), q), e AS (SELECT k, count(*)::DOUBLE n, avg(y) FILTER (t = 1) m1, avg(y) FILTER (t = 0) m0, var_samp(y) FILTER (t = 1) v1, var_samp(y) FILTER (t = 0) v0, count(*) FILTER (t = 1) n1, count(*) FILTER (t = 0) n0 FROM d GROUP BY 1) SELECT round(sum(n*(m1-m0))/sum(n), 4) AS ate, round(sqrt(sum(n*n*(v1/n1+v0/n0)))/sum(n), 4) AS std_error, count(*)::DOUBLE AS classes FROM e", 4)
def _(t):
    return one(t.spark, W.subclassification(_line(t), "y", "t", "x"))


@query("overlap", f"SELECT least(floor(z*100/11*20)::BIGINT, 19) AS bin, round(sum(t)/(SELECT sum(t) FROM ({LINE})), 8) AS treated, round(sum(1-t)/(SELECT sum(1-t) FROM ({LINE})), 8) AS control FROM ({LINE}) GROUP BY 1", 8)
def _(t):
    return W.overlap(_line(t).withColumn("p", F.col("z") * 100 / 11), "t", "p")


@query("crump_cut")
def _(t):
    return one(t.spark, {"cut": W.crump_cut(causal.propensity(_line(t), "t", ["x", "z"], 0.0), "ps")})


@query("transport", f"WITH d AS ({LINE}), e AS (SELECT c, b, count(*) FILTER (s = 0)::DOUBLE n, avg(y) FILTER (s = 1 AND t = 1) m1, avg(y) FILTER (s = 1 AND t = 0) m0 FROM d GROUP BY 1, 2) SELECT round(sum(n*(m1-m0))/sum(n) FILTER (m1 IS NOT NULL AND m0 IS NOT NULL), 4) AS effect, round(sum(n) FILTER (m1 IS NOT NULL AND m0 IS NOT NULL)/sum(n), 4) AS covered FROM e", 4)
def _(t):
    r = W.transport(_line(t), "y", "t", "s", ["c", "b"])
    return one(t.spark, {k: r[k] for k in ("effect", "covered")})


@query("doubly_robust_value", f"WITH d AS ({LINE}), q AS (SELECT c, t, avg(y) q FROM d GROUP BY 1, 2), j AS (SELECT coalesce(q.q, 0) q, CASE WHEN d.t = d.b THEN (y - coalesce(q.q, 0))/0.5 ELSE 0 END r FROM d LEFT JOIN q ON q.c = d.c AND q.t = d.b) SELECT round(avg(q), 4) AS direct, round(avg(q + r), 4) AS doubly_robust, round(stddev_samp(q + r)/sqrt(count(*)), 4) AS std_error FROM j", 4)
def _(t):
    return one(t.spark, W.doubly_robust_value(_line(t).withColumn("e", F.lit(0.5)), "y", "t", "e", F.col("b"), ["c"]))


@query("changes_in_changes", f"WITH d AS (SELECT y, t g, s t FROM ({LINE})), f00 AS (SELECT y, round(sum(n) OVER (ORDER BY y)/sum(n) OVER (), 12) p FROM (SELECT y, count(*)::DOUBLE n FROM d WHERE g = 0 AND t = 0 GROUP BY 1)), f01 AS (SELECT y, round(sum(n) OVER (ORDER BY y)/sum(n) OVER (), 12) p FROM (SELECT y, count(*)::DOUBLE n FROM d WHERE g = 0 AND t = 1 GROUP BY 1)), v AS (SELECT y, count(*)::DOUBLE n FROM d WHERE g = 1 AND t = 0 GROUP BY 1), a AS (SELECT v.n, coalesce(p, 0) p FROM v ASOF LEFT JOIN f00 ON v.y >= f00.y), m AS (SELECT a.n, f01.y FROM a ASOF JOIN f01 ON a.p <= f01.p) SELECT round((SELECT avg(y) FROM d WHERE g = 1 AND t = 1) - sum(n*y)/sum(n), 4) AS att, round(sum(n*y)/sum(n), 4) AS counterfactual FROM m", 4)
def _(t):
    r = W.changes_in_changes(_line(t), "y", "t", "s")
    return one(t.spark, {k: r[k] for k in ("att", "counterfactual")})


@query("switchers", f"WITH p AS (SELECT t, i, y, (g IS NOT NULL AND t >= g)::INT d FROM ({PANEL})), w AS (SELECT t, y - lag(y) OVER x dy, lag(d) OVER x b, d FROM p WINDOW x AS (PARTITION BY i ORDER BY t)) SELECT t AS \"time\", b::DOUBLE AS \"from\", count(*) FILTER (d <> b) AS switch, count(*) FILTER (d = b) AS stay, round((1-2*b)*(avg(dy) FILTER (d <> b) - avg(dy) FILTER (d = b)), 4) AS effect FROM w WHERE dy IS NOT NULL GROUP BY t, b HAVING count(*) FILTER (d <> b) > 0 AND count(*) FILTER (d = b) > 0", 4)
def _(t):
    return W.switchers(_panel(t), "y", "d", "i", "t")


@query("two_stage_g", f"WITH d AS ({LINE}), i AS (SELECT c, t, s, b, avg(y) q FROM d GROUP BY 1, 2, 3, 4), n AS (SELECT c, t, s, count(*)::DOUBLE n FROM d GROUP BY 1, 2, 3), o AS (SELECT c, t, b, sum(n*q)/sum(n) q FROM n JOIN i USING (c, t, s) GROUP BY 1, 2, 3), m AS (SELECT c, count(*)::DOUBLE n FROM d GROUP BY 1) SELECT t::DOUBLE AS a, b::DOUBLE AS b, round(sum(n*q)/sum(n), 4) AS mean FROM o JOIN m USING (c) GROUP BY 1, 2", 4)
def _(t):
    return W.two_stage_g(_line(t), "y", "t", "b", ["c"], ["s"])


@query("q_learning")
def _(t):
    fits = W.q_learning(_line(t), "y", "t", "s", ["z"], ["x"])
    return fits["first"].frame(t.spark).select(F.lit("first").alias("stage"), "term", "estimate").unionByName(fits["second"].frame(t.spark).select(F.lit("second").alias("stage"), "term", "estimate"))


@query("quantile_quantile", f"WITH q AS (SELECT t, quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) q FROM ({LINE}) GROUP BY 1) SELECT i/10.0::DOUBLE AS quantile, round(max(q[i]) FILTER (t = 0), 6) AS group0, round(max(q[i]) FILTER (t = 1), 6) AS group1 FROM q, range(1, 10) r(i) GROUP BY 1")
def _(t):
    return W.qq(_line(t), "y", "t")


# ---------------------------------------------------------------- survival, epidemiology, networks
SPELLS = "SELECT l_linenumber g, (l_quantity + l_linenumber)::DOUBLE t, (CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END) k FROM lineitem"


def _spells(t: Tables):
    return t.lineitem.select(F.col("l_linenumber").alias("g"), (F.col("l_quantity") + F.col("l_linenumber")).alias("t"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0).alias("k")).withColumn("e", (F.col("k") > 0).cast("int"))


@query("cumulative_incidence", f"WITH d AS ({SPELLS}), v AS (SELECT t, count(*)::DOUBLE l, count(*) FILTER (k > 0)::DOUBLE e FROM d GROUP BY 1), r AS (SELECT t, e, sum(l) OVER (ORDER BY t DESC) n FROM v), s AS (SELECT t, n, e, coalesce(product(1 - e/n) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) b FROM r), c AS (SELECT k, t, count(*) m FROM d WHERE k > 0 GROUP BY 1, 2) SELECT k AS cause, t AS \"time\", m AS n, round(sum(m*b/n) OVER (PARTITION BY k ORDER BY t), 8) AS incidence FROM c JOIN s USING (t)", 8)
def _(t):
    return survival.cumulative_incidence(_spells(t), "t", "k")


@query("life_table", f"WITH d AS (SELECT floor(t/10)*10.0::DOUBLE s, (k > 0)::INT e FROM ({SPELLS})), v AS (SELECT s, sum(e)::DOUBLE e, sum(1-e)::DOUBLE w FROM d GROUP BY 1), r AS (SELECT *, sum(e+w) OVER (ORDER BY s DESC) n FROM v) SELECT s::DOUBLE AS start, n AS entering, e AS events, w AS withdrawn, round(product(1 - e/(n - w/2)) OVER (ORDER BY s), 8) AS survival FROM r", 8)
def _(t):
    return survival.life_table(_spells(t), "t", "e", 10)


@query("incidence_rates", f"SELECT g, sum((k > 0)::INT)::DOUBLE AS events, sum(t) AS person_time, round(sum((k > 0)::INT)/sum(t), 8) AS rate FROM ({SPELLS}) GROUP BY 1", 8)
def _(t):
    return survival.incidence_rates(_spells(t), "t", "e", ["g"]).drop("ci_low", "ci_high")


TWO = "SELECT c, count(*) FILTER (b = 1 AND t = 1)::DOUBLE pa, count(*) FILTER (b = 1 AND t = 0)::DOUBLE pb, count(*) FILTER (b = 0 AND t = 1)::DOUBLE pc, count(*) FILTER (b = 0 AND t = 0)::DOUBLE pd"


@query("attributable", f"WITH x AS ({TWO} FROM ({LINE}) GROUP BY 1), r AS (SELECT c, pa/(pa+pb) r1, pc/(pc+pd) r0, (pa+pc)/(pa+pb+pc+pd) r FROM x) SELECT c AS line, round((r1-r0)/r1, 8) AS attributable_exposed, round((r-r0)/r, 8) AS attributable_population, round(1/abs(r1-r0), 4) AS number_needed FROM r", 8)
def _(t):
    return epi.attributable(epi.cells(_line(t).withColumnRenamed("c", "line"), "b", "t", ["line"])).select("line", "attributable_exposed", "attributable_population", F.round("number_needed", 4).alias("number_needed"))


@query("breslow_day", f"WITH x AS ({TWO} FROM ({LINE}) GROUP BY 1), y AS (SELECT *, pa+pb+pc+pd n, pa+pc m, pa+pb k FROM x), o AS (SELECT sum(pa*pd/n)/sum(pb*pc/n) p FROM y), e AS (SELECT *, (p*(m+k)+n-m-k - sqrt(power(p*(m+k)+n-m-k, 2) - 4*p*(p-1)*m*k))/(2*(p-1)) e FROM y, o) SELECT round(sum(power(pa-e, 2)*(1/e + 1/(m-e) + 1/(k-e) + 1/(n-m-k+e))), 5) AS chi2 FROM e", 5)
def _(t):
    return one(t.spark, {"chi2": epi.breslow_day(_line(t).withColumnRenamed("c", "line"), "b", "t", ["line"])[0]})


@query("modularity", f"WITH {UNDIRECTED.format(edges=PAIRS)}, e AS (SELECT a % 5 ca, b % 5 cb FROM u), m AS (SELECT count(*)::DOUBLE m, sum((ca = cb)::INT) i FROM e), k AS (SELECT sum(power(n, 2)) k FROM (SELECT count(*)::DOUBLE n FROM (SELECT ca c FROM e UNION ALL SELECT cb FROM e) GROUP BY c)) SELECT round(i/m - k/(4*m*m), 8) AS q FROM m, k", 8)
def _(t):
    nodes = t.part.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 5).alias("c"))
    return one(t.spark, {"q": graph.modularity(_pairs(t), nodes)})


@query("core_numbers")
def _(t):
    x, y = (t.nation.select(F.col("n_nationkey").alias(c), F.col("n_regionkey").alias(f"r_{c}")) for c in ("src", "dst"))
    return graph.core_numbers(_edges(t).join(x, "src").join(y, "dst").where("r_src = r_dst and src <> dst"))
