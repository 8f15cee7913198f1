"""Queries of networks and grids, panels and projections, calibration, frontiers, dominance and design."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from abacist.operators import did, epi, experiments, graph, inequality, rd, series, survey
from abacist.plans.breadth import LINE, _line
from abacist.plans.graphs import EDGES, NEAR, PAIRS, POINTS, UNDIRECTED, _edges, _met, _points
from abacist.plans.models import PANEL, _panel, _slopes
from abacist.plans.registry import one, query

# ---------------------------------------------------------------- networks and grids
@query("katz_centrality")
def _(t):
    e = _edges(t)
    total = e.agg(F.sum("w")).first()[0]
    return graph.katz_centrality(e.withColumn("w", F.col("w") / total), 0.5)


@query("eigenvector_centrality")
def _(t):
    return graph.eigenvector_centrality(_edges(t))


@query("hits")
def _(t):
    return graph.hits(_edges(t))


#: Customers of one nation and segment in two chains, by balance and by key: a sparse graph with long paths.
CHAIN = """SELECT DISTINCT src, dst FROM (SELECT c_custkey AS src, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey) AS dst FROM customer
UNION ALL SELECT c_custkey, lead(c_custkey, 3) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) FROM customer) WHERE dst IS NOT NULL"""
#: Its paths from every customer: steps, and how many shortest ones.
WALKS = f"""e AS ({CHAIN}), r AS (SELECT c_custkey AS source, c_custkey AS node, 0 AS steps FROM customer UNION SELECT r.source, e.dst, r.steps + 1 FROM r JOIN e ON e.src = r.node WHERE r.steps < 60),
d AS (SELECT source, node, min(steps) AS steps FROM r GROUP BY source, node)"""


def _chain(t):
    by = lambda *order: Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(*order)
    one_ = t.customer.select(F.col("c_custkey").alias("src"), F.lead("c_custkey").over(by("c_acctbal", "c_custkey")).alias("dst"))
    two = t.customer.select(F.col("c_custkey").alias("src"), F.lead("c_custkey", 3).over(by("c_custkey")).alias("dst"))
    return one_.unionByName(two).where("dst is not null").distinct().withColumn("w", F.lit(1.0))


def _customers(t):
    return t.customer.select(F.col("c_custkey").alias("node"))


@query("path_lengths", f"WITH RECURSIVE {WALKS} SELECT source, node, steps FROM d")
def _(t):
    return graph.path_lengths(_chain(t), _customers(t))


@query("closeness", f"WITH RECURSIVE {WALKS}, n AS (SELECT count(DISTINCT v) n FROM (SELECT src v FROM e UNION ALL SELECT dst FROM e)) SELECT source AS node, round(count(*)/sum(steps)*count(*)/(any_value(n) - 1), 8) AS closeness FROM d, n WHERE steps > 0 GROUP BY source", 8)
def _(t):
    return graph.closeness(_chain(t), _customers(t))


@query("betweenness", f"""WITH RECURSIVE {WALKS}, g AS (SELECT source, node, 0 AS steps, 1.0::DOUBLE AS paths FROM d WHERE steps = 0 UNION ALL
  SELECT g.source, e.dst, any_value(g.steps) + 1, sum(g.paths) FROM g JOIN e ON e.src = g.node JOIN d ON d.source = g.source AND d.node = e.dst AND d.steps = g.steps + 1 GROUP BY g.source, e.dst),
b AS (SELECT x.node, sum(x.paths*y.paths/z.paths) b FROM g x JOIN g y ON y.source = x.node JOIN g z ON z.source = x.source AND z.node = y.node AND z.steps = x.steps + y.steps WHERE x.node <> x.source AND y.node <> x.node GROUP BY x.node)
SELECT v AS node, round(coalesce(b, 0), 6) AS betweenness FROM (SELECT src v FROM e UNION SELECT dst FROM e) LEFT JOIN b ON b.node = v""")
def _(t):
    return graph.betweenness_centrality(_chain(t))


@query("communities")
def _(t):
    return graph.communities(_chain(t))


@query("transitivity", f"WITH {UNDIRECTED.format(edges=PAIRS)}, d AS (SELECT sum(n*(n-1)/2.0) d FROM (SELECT count(*)::DOUBLE n FROM s GROUP BY a)), t AS (SELECT count(*)::DOUBLE n FROM s x JOIN s y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b) SELECT round(n/d, 8) AS transitivity FROM d, t", 8)
def _(t):
    return one(t.spark, {"transitivity": graph.transitivity(_met(t))})


@query("queen", f"WITH p AS ({POINTS}) SELECT a.id AS i, b.id AS j, 1.0::DOUBLE AS w FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1")
def _(t):
    return graph.rook(_points(t), queen=True)


@query("rook", f"WITH p AS ({POINTS}) SELECT a.id AS i, b.id AS j, 1.0::DOUBLE AS w FROM p a JOIN p b ON abs(a.x - b.x) + abs(a.y - b.y) = 1")
def _(t):
    return graph.rook(_points(t))


@query("join_counts", f"WITH {NEAR}, v AS (SELECT id, (v > 0)::INT v FROM p) SELECT round(sum(a.v*b.v)/2.0, 4) AS bb, round(sum((1-a.v)*(1-b.v))/2.0, 4) AS ww, round(sum((a.v-b.v)*(a.v-b.v))/2.0, 4) AS bw FROM w JOIN v a ON a.id = i JOIN v b ON b.id = j")
def _(t):
    p = _points(t)
    return one(t.spark, graph.join_counts(graph.distance_band(p, 1.5), p.withColumn("v", (F.col("v") > 0).cast("int"))))


@query("local_getis", f"WITH {NEAR}, s AS (SELECT count(*)::DOUBLE n, sum(v) s, sum(v*v) q FROM p), g AS (SELECT i, sum(b.v) g, count(*)::DOUBLE k FROM w JOIN p b ON b.id = j GROUP BY i), m AS (SELECT i AS id, g, k, n, (s - v)/(n-1) m, (q - v*v)/(n-1) q FROM g JOIN p ON p.id = i, s) SELECT id, round((g - k*m)/(sqrt(q - m*m)*sqrt(((n-1)*k - k*k)/(n-2))), 6) AS z FROM m")
def _(t):
    return graph.local_getis(graph.distance_band(_points(t), 1.5), _points(t))


# ---------------------------------------------------------------- panels
@query("local_projection_did", "WITH p AS (" + PANEL + """), b AS (SELECT x.i, x.t, x.g, o.y y0 FROM p x JOIN p o ON o.i = x.i AND o.t = x.t - 1), h AS (SELECT unnest([-3, -2, 0, 1, 2, 3]) h),
d AS (SELECT h, b.t, (b.g IS NOT NULL AND b.g = b.t)::INT d, l.y - y0 dy FROM b CROSS JOIN h JOIN p l ON l.i = b.i AND l.t = b.t + h WHERE b.g IS NULL OR b.g = b.t OR b.g > b.t + greatest(h, 0)),
m AS (SELECT h, d - avg(d) OVER w AS d, dy - avg(dy) OVER w AS dy FROM d WINDOW w AS (PARTITION BY h, t))
SELECT h AS horizon, round(sum(d*dy)/sum(d*d), 4) AS att FROM m GROUP BY h HAVING sum(d*d) > 1e-9""", 4)
def _(t):
    return did.local_projection_did(_panel(t), "y", "g", "i", "t").select("horizon", "att")


@query("pretrends")
def _(t):
    return one(t.spark, did.pretrends(_panel(t), "y", "g", "i", "t"))


@query("panel_unit_root", f"WITH d AS (SELECT i, lag(y) OVER w x, y - lag(y) OVER w dy FROM ({PANEL}) WINDOW w AS (PARTITION BY i ORDER BY t)), s AS (SELECT i, count(*)::DOUBLE n, regr_sxx(dy, x) xx, regr_sxy(dy, x) xy, regr_syy(dy, x) yy FROM d WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) > 3) SELECT round(avg(xy/xx/sqrt((yy - xy*xy/xx)/(n-2)/xx)), 6) AS t_bar, count(*)::DOUBLE AS units FROM s")
def _(t):
    return one(t.spark, series.panel_unit_root(_panel(t), "y", "i", "t"))


@query("synthetic_did")
def _(t):
    d = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("u"), F.trunc("l_shipdate", "quarter").alias("t")).agg(F.avg("l_extendedprice").alias("y"))
    at = d.agg(F.min("u"), F.array_sort(F.collect_set("t"))).first()
    return one(t.spark, series.synthetic_did(d, "y", "u", "t", [at[0]], at[1][2 * len(at[1]) // 3]))


@query("mr_leave_one_out", "WITH v AS (SELECT l_suppkey k, regr_slope(l_quantity, l_linenumber) x, regr_slope(l_extendedprice, l_linenumber) y, 1 + l_suppkey % 3 s FROM lineitem GROUP BY 1), a AS (SELECT sum(x*x/s/s) xx, sum(x*y/s/s) xy FROM v) SELECT k AS variant, round((xy - x*y/s/s)/(xx - x*x/s/s), 5) AS ivw, round(1/sqrt(xx - x*x/s/s), 5) AS std_error FROM v, a", 5)
def _(t):
    v = t.lineitem.groupBy("l_suppkey").agg(F.regr_slope("l_quantity", "l_linenumber").alias("x"), F.regr_slope("l_extendedprice", "l_linenumber").alias("y")).withColumn("s", 1 + F.col("l_suppkey") % 3)
    return series.mr_leave_one_out(v, "l_suppkey", "x", "y", "s")


# ---------------------------------------------------------------- design, calibration, frontiers, dominance
@query("calibrate", "WITH d AS (SELECT o_orderkey k, o_totalprice x, 2.0::DOUBLE w FROM orders), s AS (SELECT sum(w) n, sum(w*x) t, sum(w*x*x) q FROM d), g AS (SELECT (1.01*n - n)*q/(n*q - t*t) - (1.02*t - t)*t/(n*q - t*t) a, (1.02*t - t)*n/(n*q - t*t) - (1.01*n - n)*t/(n*q - t*t) b FROM s) SELECT k, round(w*(1 + a + b*x), 6) AS calibrated FROM d, g")
def _(t):
    d = t.orders.select(F.col("o_orderkey").alias("k"), F.lit(1.0).alias("one"), F.col("o_totalprice").alias("x"), F.lit(2.0).alias("w"))
    n, s = d.agg(F.sum("w"), F.sum(F.col("w") * F.col("x"))).first()
    return survey.calibrate(d, {"one": 1.01 * n, "x": 1.02 * s}, "w").select("k", "calibrated")


@query("neyman", "WITH d AS (SELECT o_orderstatus s, count(*) n, stddev_samp(o_totalprice) sd FROM orders GROUP BY 1) SELECT s AS stratum, n AS size, round(n*sd/sum(n*sd) OVER (), 8) AS share, round(n*sd/sum(n*sd) OVER ()*1000)::BIGINT AS sample FROM d", 8)
def _(t):
    return experiments.neyman(t.orders, "o_totalprice", "o_orderstatus", 1000)


@query("prediction_powered_mean", "WITH d AS (SELECT CASE WHEN l_linestatus = 'O' THEN l_extendedprice END y, l_quantity*2000 f FROM lineitem) SELECT round(avg(f) FILTER (y IS NULL) + avg(y - f), 4) AS mean, round(sqrt(var_samp(f) FILTER (y IS NULL)/count(*) FILTER (y IS NULL) + var_samp(y - f)/count(y)), 4) AS std_error FROM d", 4)
def _(t):
    d = t.lineitem.select(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).alias("y"), (F.col("l_quantity") * 2000).alias("f"))
    r = experiments.prediction_powered_mean(d, "y", "f")
    return one(t.spark, {k: r[k] for k in ("mean", "std_error")})


@query("pairwise_means", f"WITH m AS (SELECT f, avg(y) m, var_samp(y) v, count(*) n FROM ({LINE}) GROUP BY 1) SELECT x.f AS a, z.f AS b, round(z.m - x.m, 4) AS difference, round(sqrt(x.v/x.n + z.v/z.n), 4) AS std_error FROM m x JOIN m z ON x.f < z.f", 4)
def _(t):
    return experiments.pairwise_means(_line(t), "y", "f")


@query("frontier", f"WITH d AS (SELECT -y*y/1e9 AS y, x FROM ({LINE})), k AS (SELECT regr_slope(y, x) b, regr_intercept(y, x) a FROM d), m AS (SELECT any_value(a) a, any_value(b) b, avg(power(y-a-b*x, 2)) m2, avg(power(y-a-b*x, 3)) m3 FROM d, k), u AS (SELECT *, power(greatest(-m3, 0)/(sqrt(2/pi())*(4/pi()-1)), 1/3.0::DOUBLE) su FROM m) SELECT round(a + su*sqrt(2/pi()), 6) AS intercept, round(b, 6) AS x, round(su, 6) AS sigma_u, round(sqrt(greatest(m2 - (1-2/pi())*su*su, 0)), 6) AS sigma_v FROM u")
def _(t):
    r = experiments.frontier(_line(t).withColumn("y", -F.col("y") * F.col("y") / 1e9), "y", ["x"])
    return one(t.spark, {k: r[k] for k in ("intercept", "x", "sigma_u", "sigma_v")})


@query("stepwise")
def _(t):
    return t.spark.createDataFrame(experiments.stepwise(_line(t).withColumn("y", F.col("y") + 2000 * F.col("x")), "y", ["x", "z", "c", "t", "s"]), "term string, bic double")


@query("dominance", f"WITH v AS (SELECT y, sum(t)::DOUBLE b, sum(1-t)::DOUBLE a FROM ({LINE}) GROUP BY 1), r AS (SELECT y, sum(b) OVER w/sum(b) OVER () - sum(a) OVER w/sum(a) OVER () gap, lead(y) OVER w - y AS step FROM v WINDOW w AS (ORDER BY y)), s AS (SELECT gap, coalesce(sum(gap*step) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) area FROM r) SELECT round(max(gap), 8) AS first_max, round(min(gap), 8) AS first_min, round(max(area), 4) AS second_max, round(min(area), 4) AS second_min FROM s", 8)
def _(t):
    r = inequality.dominance(_line(t), "y", "t")
    return one(t.spark, r).select("first_max", "first_min", F.round("second_max", 4).alias("second_max"), F.round("second_min", 4).alias("second_min"))


@query("quantile_gap")
def _(t):
    return inequality.quantile_gap(_line(t), "y", ["x"], "t")


@query("rd_checks")
def _(t):
    d = t.orders.select(((F.col("o_totalprice") - 250000) / 100000).alias("x"), (F.col("o_custkey") % 97).cast("double").alias("y"), (F.col("o_orderkey") % 89).cast("double").alias("z"))
    return rd.checks(d, "y", "x", 0.0, ["z"], placebos=[-0.3, 0.3], donut=0.02)


@query("rd_multi_cutoff")
def _(t):
    d = t.orders.select(F.col("o_totalprice").alias("y"), (F.col("o_orderkey") % 1000).alias("x"), F.when(F.col("o_orderstatus") == "F", 300).otherwise(600).alias("c"))
    return rd.multi_cutoff(d, "y", "x", "c", 150.0)


@query("fisher_exact")
def _(t):
    n = t.labels.where("quality is not null and toxic is not null").groupBy("quality", "toxic").count().collect()
    cell = {(r.quality, r.toxic): r["count"] for r in n}
    return one(t.spark, epi.fisher_exact(*(cell.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))))


@query("ancova", f"WITH d AS (SELECT y, t a, x b FROM ({LINE})), s AS (SELECT var_pop(a) aa, covar_pop(a, b) ab, var_pop(b) bb, covar_pop(a, y) ay, covar_pop(b, y) yb FROM d) SELECT 't' AS term, round((bb*ay - ab*yb)/(aa*bb - ab*ab), 4) AS estimate FROM s", 4)
def _(t):
    from abacist.operators.regression import regress

    return _slopes(regress("y ~ t + x", _line(t)), t).where("term = 't'").select("term", "estimate")
