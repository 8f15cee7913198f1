"""Queries of absorbed Poisson models, nearest neighbours, matching, spatial regressions and bias-corrected cutoffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.operators import competing, distreg, emulation, forest, neighbours, rd_robust, regression, spatial, weak
from abacist.plans.registry import Tables, one, query
from abacist.streaming import particles



# ---------------------------------------------------------------- Poisson with absorbed effects
@query("poisson_absorbed", """WITH RECURSIVE c AS (SELECT l_suppkey, sum((l_quantity > 25)::INT) n1, sum((l_quantity <= 25)::INT) n0, sum(l_linenumber) y, sum(l_linenumber) FILTER (l_quantity > 25) s1 FROM lineitem GROUP BY 1 HAVING count(*) > 1),
it AS (SELECT 0 AS k, 0.0::DOUBLE AS b UNION ALL
  SELECT any_value(k) + 1, any_value(b) + sum(coalesce(s1, 0) - y*n1*exp(b)/(n0 + n1*exp(b))) / sum(y*n1*exp(b)/(n0 + n1*exp(b))*(n0/(n0 + n1*exp(b)))) FROM it, c HAVING any_value(k) < 15),
z AS (SELECT b FROM it ORDER BY k DESC LIMIT 1)
SELECT 'x' AS term, round(any_value(b), 6) AS estimate, round(sqrt(1/sum(y*n1*exp(b)/(n0 + n1*exp(b))*(n0/(n0 + n1*exp(b)))) * sum(n0 + n1) / (sum(n0 + n1) - 1 - (count(*) - 1))), 6) AS std_error FROM c, z""")
def _(t):
    d = t.lineitem.select(F.col("l_linenumber").alias("y"), (F.col("l_quantity") > 25).cast("double").alias("x"), F.col("l_suppkey").alias("g"))
    return regression.regress("y ~ x | g", d, family="poisson").frame(t.spark).select("term", "estimate", "std_error")


@query("poisson_twoway")
def _(t):
    d = t.lineitem.select(F.col("l_linenumber").alias("y"), (F.col("l_quantity") / 10).alias("x"), F.col("l_suppkey").alias("g"), F.year("l_shipdate").alias("t"))
    return regression.regress("y ~ x | g + t", d, family="poisson", cluster="g").frame(t.spark).select("term", "estimate", "std_error")


# ---------------------------------------------------------------- neighbours
BUYER = "SELECT c_custkey AS id, (c_mktsegment = 'BUILDING')::INT AS t, c_acctbal AS bal, c_acctbal/1000 AS a, avg(o_totalprice)/10000 AS b, sum(o_totalprice)/123457 AS y, count(*)::DOUBLE AS x FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3"
PAIRS = f"c AS ({BUYER}), p AS (SELECT q.id AS query, r.id AS point, sqrt((q.a-r.a)*(q.a-r.a) + (q.b-r.b)*(q.b-r.b)) AS d FROM c q, c r)"


def _buyers(t: Tables):
    per = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("m"), F.sum("o_totalprice").alias("s"), F.count("*").cast("double").alias("x"))
    c = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("t"), F.col("c_acctbal").alias("bal"))
    return c.join(per, "id").select("id", "t", "bal", (F.col("bal") / 1000).alias("a"), (F.col("m") / 10000).alias("b"), (F.col("s") / 123457).alias("y"), "x")


@query("knn_join", f"WITH {PAIRS} SELECT query, (row_number() OVER (PARTITION BY query ORDER BY d, point))::INT AS rank, point, round(d, 6) AS distance FROM p WHERE query <> point QUALIFY rank <= 5")
def _(t):
    b = _buyers(t)
    return neighbours.nearest(b, b, 5, ["a", "b"], query_id="id", apart=True)


@query("knn_lag", f"WITH {PAIRS}, n AS (SELECT query, point FROM p WHERE query <> point QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, point) <= 8) SELECT c.id AS i, round(c.y, 6) AS value, round(avg(r.y), 6) AS lag FROM c JOIN n ON n.query = c.id JOIN c r ON r.id = n.point GROUP BY c.id, c.y")
def _(t):
    b = _buyers(t)
    return neighbours.spatial_lag(b, neighbours.knn_weights(b, ["a", "b"], 8, id_col="id"), "y", "id")


@query("kernel_lag", f"""WITH {PAIRS}, n AS (SELECT query, point, d, row_number() OVER (PARTITION BY query ORDER BY d, point) k FROM p WHERE query <> point QUALIFY k <= 6), h AS (SELECT query, max(d) h FROM n GROUP BY 1),
w AS (SELECT query, point, 0.75*(1 - (d/h)*(d/h)) w FROM n JOIN h USING (query) UNION ALL SELECT id, id, 0.75 FROM c) SELECT c.id AS i, round(c.y, 6) AS value, round(sum(w*r.y), 6) AS lag FROM c JOIN w ON w.query = c.id JOIN c r ON r.id = w.point GROUP BY c.id, c.y""")
def _(t):
    b = _buyers(t)
    return neighbours.spatial_lag(b, neighbours.kernel_weights(b, ["a", "b"], 6, id_col="id", kernel="epanechnikov"), "y", "id")


@query("match_mahalanobis", f"""WITH c AS ({BUYER}), v AS (SELECT var_samp(a) aa, covar_samp(a, b) ab, var_samp(b) bb FROM c),
p AS (SELECT q.id AS query, r.id AS point, q.y - r.y AS e, (bb*(q.a-r.a)*(q.a-r.a) - 2*ab*(q.a-r.a)*(q.b-r.b) + aa*(q.b-r.b)*(q.b-r.b)) / (aa*bb - ab*ab) AS d FROM c q, c r, v WHERE q.t = 1 AND r.t = 0),
n AS (SELECT query, avg(e) e FROM (SELECT query, e FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, point) <= 2) GROUP BY 1) SELECT round(avg(e), 6) AS att, count(*)::DOUBLE AS n FROM n""")
def _(t):
    fit, _ = neighbours.match(_buyers(t), "y", "t", ["a", "b"], id_col="id", k=2)
    return one(t.spark, {"att": fit["att"], "n": fit.n})


# ---------------------------------------------------------------- space
@query("gwr", f"""WITH {PAIRS}, n AS (SELECT query, point, d FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, point) <= 40), h AS (SELECT query, max(d) h FROM n GROUP BY 1),
w AS (SELECT query, CASE WHEN d < h THEN power(1 - (d/h)*(d/h), 2) ELSE 0 END w, c.x, c.y FROM n JOIN h USING (query) JOIN c ON c.id = n.point),
m AS (SELECT query, sum(w) w, sum(w*x)/sum(w) mx, sum(w*y)/sum(w) my FROM w GROUP BY 1), s AS (SELECT query, sum(w.w*(x-mx)*(y-my))/sum(w.w*(x-mx)*(x-mx)) b, any_value(mx) mx, any_value(my) my FROM w JOIN m USING (query) GROUP BY 1)
SELECT query AS id, round(my - s.b*mx, 4) AS "b_Intercept", round(s.b, 4) AS b_x, round(my + s.b*(c.x - mx), 4) AS predicted FROM s JOIN c ON c.id = query""", 4)
def _(t):
    return spatial.gwr(_buyers(t), "y", ["x"], ["a", "b"], 40, id_col="id")[0].select("id", "b_Intercept", "b_x", "predicted")


def _sellers(t: Tables):
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg((F.avg("l_extendedprice") / 1000).alias("y"), F.avg("l_quantity").alias("x"), (F.avg("l_discount") * 100).alias("b"))
    return t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("a")).join(per, "id")


@query("sar")
def _(t):
    s = _sellers(t)
    return spatial.sar(s, neighbours.knn_weights(s, ["a", "b"], 5, id_col="id"), "y", ["x"], id_col="id").frame(t.spark).select("term", "estimate", "std_error")


@query("sem")
def _(t):
    s = _sellers(t)
    return spatial.sem(s, neighbours.knn_weights(s, ["a", "b"], 5, id_col="id"), "y", ["x"], id_col="id").frame(t.spark).select("term", "estimate", "std_error")


# ---------------------------------------------------------------- cutoffs
BASKET = "SELECT o_totalprice - 150000 AS x, sum(l_quantity) AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice"


def _baskets(t: Tables):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", F.col("o_totalprice").alias("x")).agg(F.sum("l_quantity").alias("y"))


@query("rd_reference_bandwidth", f"""WITH d AS ({BASKET}), r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 k, count(*) OVER () n FROM d),
q AS (SELECT max(x) FILTER (k = floor((n - 1) * 0.75)) - max(x) FILTER (k = floor((n - 1) * 0.25)) iq FROM r), m AS (SELECT stddev_samp(x) s, count(DISTINCT x) u, greatest(abs(min(x)), abs(max(x))) w FROM d)
SELECT round(least(2.576 * least(s, iq / 1.349) * power(u, -0.2), w), 4) AS h FROM m, q""", 4)
def _(t):
    return one(t.spark, {"h": rd_robust.bandwidths(_baskets(t), "y", "x", 150000.0)["reference"]})


@query("rd_bandwidths", digits=4)
def _(t):
    table, held = rd_robust.value_table(_baskets(t), "y", "x", 150000.0), {}
    rows = [(s, *(v[c] for c in ("h_left", "h_right", "b_left", "b_right"))) for s in ("mserd", "msetwo", "cerrd") for v in [rd_robust.bandwidths(table, "y", "x", 0.0, select=s, table=table, held=held)]]
    return t.spark.createDataFrame(rows, "method string, h_left double, h_right double, b_left double, b_right double")


@query("rd_robust")
def _(t):
    return one(t.spark, rd_robust.robust(_baskets(t), "y", "x", 150000.0))


# ---------------------------------------------------------------- competing risks
WAIT = "SELECT date_diff('day', o_orderdate, l_shipdate)::DOUBLE AS t, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS e, (l_quantity > 25)::INT AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _wait(t: Tables):
    e = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0)
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.datediff("l_shipdate", "o_orderdate").cast("double").alias("t"), e.alias("e"), (F.col("l_quantity") > 25).cast("double").alias("x"))


@query("finegray", f"""WITH RECURSIVE d AS ({WAIT}), p AS (SELECT t, count(*)::DOUBLE c, (count(*) FILTER (e = 0))::DOUBLE z, (count(*) FILTER (e = 1))::DOUBLE m, (count(*) FILTER (e = 1 AND x = 1))::DOUBLE m1, (count(*) FILTER (x = 0))::DOUBLE a, (count(*) FILTER (x = 1))::DOUBLE b,
  (count(*) FILTER (e = 2 AND x = 0))::DOUBLE oa, (count(*) FILTER (e = 2 AND x = 1))::DOUBLE ob FROM d GROUP BY t),
r AS (SELECT *, sum(c) OVER w n, sum(a) OVER w ra, sum(b) OVER w rb FROM p WINDOW w AS (ORDER BY t DESC)),
g AS (SELECT *, exp(coalesce(sum(CASE WHEN z < n THEN ln(1 - z/n) ELSE 0 END) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) g FROM r),
s AS (SELECT m, m1, ra + g*coalesce(sum(oa/g) OVER v, 0) a, rb + g*coalesce(sum(ob/g) OVER v, 0) b FROM g WINDOW v AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
it AS (SELECT 0 AS k, 0.0::DOUBLE AS beta UNION ALL SELECT any_value(k) + 1, any_value(beta) + sum(m1 - m*b*exp(beta)/(a + b*exp(beta))) / sum(m*b*exp(beta)*a/power(a + b*exp(beta), 2)) FROM it, s WHERE m > 0 HAVING any_value(k) < 12),
z AS (SELECT beta FROM it ORDER BY k DESC LIMIT 1) SELECT 'x' AS term, round(any_value(beta), 6) AS estimate, round(1/sqrt(sum(m*b*exp(beta)*a/power(a + b*exp(beta), 2))), 6) AS std_error FROM s, z WHERE m > 0""")
def _(t):
    return competing.finegray(_wait(t), "t", "e", ["x"]).frame(t.spark).select("term", "estimate", "std_error")


# ---------------------------------------------------------------- trial emulation
VISITS = "SELECT l_suppkey AS i, year(l_shipdate) AS t, (avg(l_quantity) > 25.3)::INT AS a, (avg(l_discount) > 0.05)::INT AS z FROM lineitem GROUP BY 1, 2"


@query("clone_censor_weight", f"""WITH p AS ({VISITS}), c AS (SELECT p.*, s AS strategy, a = (s = 'always')::INT AS ok FROM p, (VALUES ('always'), ('never')) v(s)),
m AS (SELECT *, bool_and(ok) OVER (PARTITION BY i, strategy ORDER BY t) AS follows, lead(ok) OVER (PARTITION BY i, strategy ORDER BY t) AS nxt FROM c), k AS (SELECT *, coalesce((NOT nxt)::INT, 0) AS censored FROM m WHERE follows),
h AS (SELECT strategy, z, avg(censored) AS h FROM k WHERE nxt IS NOT NULL GROUP BY 1, 2), g AS (SELECT strategy, avg(censored) AS g FROM k WHERE nxt IS NOT NULL GROUP BY 1)
SELECT i, t, a, z, strategy, censored, round(exp(coalesce(sum(CASE WHEN nxt IS NOT NULL THEN ln((1 - g)/(1 - h)) ELSE 0 END) OVER (PARTITION BY i, strategy ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 5) AS weight FROM k JOIN h USING (strategy, z) JOIN g USING (strategy)""", 5)
def _(t):
    # whole numbers: many averages lie at 0.05 itself, where the order of adding doubles would decide
    tenths, hundredths = F.round(F.col("l_quantity") * 10).cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("i"), F.year("l_shipdate").alias("t")).agg((F.sum(tenths) > 253 * F.count("*")).cast("int").alias("a"), (F.sum(hundredths) > 5 * F.count("*")).cast("int").alias("z"))
    return emulation.clone_censor_weight(p, "i", "t", {"always": F.col("a") == 1, "never": F.col("a") == 0}, ["z"])


# ---------------------------------------------------------------- weak instruments
IV = "SELECT l_extendedprice AS y, l_quantity AS d, p_size AS z FROM lineitem JOIN part ON l_partkey = p_partkey"


def _iv(t: Tables):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("d"), F.col("p_size").alias("z"), F.col("l_linenumber").alias("z2"), F.col("l_discount").alias("w"), F.col("l_suppkey").alias("g"))


@query("weak_one_instrument", f"""WITH d AS ({IV}), k AS (SELECT avg(y) my, avg(d) md, avg(z) mz, regr_slope(d, z) p, regr_slope(y - 1000*d, z) q, regr_sxx(z, z) zz, count(*) n FROM d),
s AS (SELECT any_value(p) p, any_value(q) q, any_value(zz) zz, any_value(n) n, sum(power(z - mz, 2)*power(d - md - p*(z - mz), 2)) w, sum(power(y - my - 1000*(d - md) - q*(z - mz), 2))/(any_value(n) - 2) v FROM d, k)
SELECT round(p*p*zz*zz/w, 6) AS rank_wald, round(p*p*zz*zz/w*(n - 2)/n, 6) AS effective_f, round(q*q*zz/v, 6) AS likelihood_ratio FROM s""")
def _(t):
    d = _iv(t)
    return one(t.spark, {"rank_wald": weak.kleibergen_paap(d, ["d"], ["z"])["wald"], "effective_f": weak.effective_f(d, "d", ["z"])["effective_f"], "likelihood_ratio": weak.conditional_lr(d, "y", "d", ["z"], beta0=1000.0)["statistic"]})


@query("weak_clustered")
def _(t):
    d = _iv(t)
    r, e, c = weak.kleibergen_paap(d, ["d"], ["z", "z2"], ["w"], cluster="g"), weak.effective_f(d, "d", ["z", "z2"], ["w"], cluster="g"), weak.conditional_lr(d, "y", "d", ["z", "z2"], ["w"], 1000.0)
    return one(t.spark, {"rank_wald": r["wald"], "p_value": r["p_value"], "cragg_donald": r["cragg_donald"], "effective_f": e["effective_f"], "likelihood_ratio": c["statistic"], "lr_p_value": c["p_value"]})


# ---------------------------------------------------------------- distribution regression
CUTS = list(range(10_000, 100_000, 5000))
_HELD = "SELECT (l_returnflag = 'R')::INT g, (l_quantity > 25)::INT x, l_extendedprice y FROM lineitem"


@query("distribution_gap", f"""WITH d AS ({_HELD}), c AS (SELECT unnest({CUTS})::DOUBLE c), n AS (SELECT g, x, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY g) AS w FROM d GROUP BY 1, 2),
f AS (SELECT g, x, c, avg((y <= c)::INT) p FROM d, c GROUP BY 1, 2, 3)
SELECT c AS cut, round(sum(p*n.w) FILTER (f.g = 0 AND n.g = 0), 6) AS f_0, round(sum(p*n.w) FILTER (f.g = 1 AND n.g = 1), 6) AS f_1, round(sum(p*n.w) FILTER (f.g = 0 AND n.g = 1), 6) AS f_counterfactual FROM f JOIN n USING (x) GROUP BY 1""")
def _(t):
    d = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("g"), (F.col("l_quantity") > 25).cast("int").alias("x"), F.col("l_extendedprice").alias("y"))
    at, *f = distreg.counterfactual(d, "y", ["x"], "g", CUTS)
    return t.spark.createDataFrame(list(zip(at, *(v.tolist() for v in f))), "cut double, f_0 double, f_1 double, f_counterfactual double")


@query("quantile_decomposition")
def _(t):
    d = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("g"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("z"), F.col("l_extendedprice").alias("y"))
    return distreg.cfm(d, "y", ["x", "z"], "g")


# ---------------------------------------------------------------- trees
def _level(i: int) -> str:
    """One level of a regression tree over ``d<i>`` (y, x, q, node n); ``d<i+1>`` has the next nodes."""
    return f"""s{i} AS (SELECT n, 0 f, x b, count(*)::DOUBLE m, sum(y) a FROM d{i} GROUP BY ALL UNION ALL SELECT n, 1, q, count(*)::DOUBLE, sum(y) FROM d{i} GROUP BY ALL),
c{i} AS (SELECT n, f, b, sum(m) OVER w lm, sum(a) OVER w la, sum(m) OVER g tm, sum(a) OVER g ta FROM s{i} WINDOW w AS (PARTITION BY n, f ORDER BY b), g AS (PARTITION BY n, f)),
p{i} AS (SELECT n, f, b FROM c{i} WHERE lm >= 50 AND tm - lm >= 50 QUALIFY row_number() OVER (PARTITION BY n ORDER BY la*la/lm + (ta-la)*(ta-la)/(tm-lm) DESC, f, b) = 1),
d{i + 1} AS (SELECT y, x, q, CASE WHEN p{i}.n IS NULL THEN d{i}.n ELSE 2*d{i}.n + (CASE f WHEN 0 THEN x ELSE q END > b)::INT END AS n FROM d{i} LEFT JOIN p{i} ON p{i}.n = d{i}.n)"""


@query("regression_tree", "WITH d0 AS (SELECT l_extendedprice*(1 + l_discount) y, l_linenumber x, floor(l_quantity/5)::INT q, 1 AS n FROM lineitem), " + ", ".join(map(_level, range(3))) + " SELECT n AS node, count(*) AS size, round(avg(y), 4) AS mean FROM d3 GROUP BY 1", 4)
def _(t):
    d = t.lineitem.select((F.col("l_extendedprice") * (1 + F.col("l_discount"))).alias("y"), F.col("l_linenumber").alias("x"), F.floor(F.col("l_quantity") / 5).alias("q"), F.lit(1.0).alias("one"))
    f = forest.grow(d, "y", "one", ["x", "q"], depth=3, least=50, cuts=[[float(v) for v in range(1, 7)], [float(v) for v in range(10)]])
    return d.groupBy(f.leaves({"x": F.col("x"), "q": F.col("q")})[0].alias("node")).agg(F.count("*").alias("size"), F.avg("y").alias("mean"))


def _arms(t: Tables):
    return t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("k"), F.col("l_extendedprice").alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("t"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("z"))


@query("causal_forest_calibration")
def _(t):
    rows, _ = forest.causal_forest(_arms(t), "y", "t", ["x", "z"], "k", trees=8, depth=3, least=50)
    return forest.calibration(rows, "y", "t").frame(t.spark).select("term", "estimate", "std_error")


@query("causal_forest_ranked")
def _(t):
    rows, _ = forest.causal_forest(_arms(t), "y", "t", ["x", "z"], "k", trees=8, depth=3, least=50)
    return one(t.spark, forest.ranked_effect(rows, "__score", "effect"))


@query("ranked_effect", """WITH d AS (SELECT l_quantity p, l_extendedprice*(0.1 - l_discount) s FROM lineitem), o AS (SELECT p, s, row_number() OVER (ORDER BY p DESC) AS k, count(*) OVER ()::DOUBLE AS n FROM d), h AS (SELECT *, sum(1.0::DOUBLE/k) OVER () - coalesce(sum(1.0::DOUBLE/k) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS w, (n - k + 1)/n - (n + 1)/(2*n) AS v FROM o),
g AS (SELECT p, sum(s) a, avg(w) w, avg(v) v, any_value(n) n FROM h GROUP BY 1) SELECT round(sum(w*a)/any_value(n), 4) AS autoc, round(sum(v*a)/any_value(n), 4) AS qini FROM g""", 4)
def _(t):
    d = t.lineitem.select(F.col("l_quantity").alias("p"), (F.col("l_extendedprice") * (0.1 - F.col("l_discount"))).alias("s"))
    return one(t.spark, {"autoc": forest.ranked_effect(d, "s", "p")["estimate"], "qini": forest.ranked_effect(d, "s", "p", "QINI")["estimate"]})


# ---------------------------------------------------------------- particles
@query("particle_filter")
def _(t):
    d = t.events.select("user_id", "event_id", "value", F.lit(2.0).alias("se"))
    return particles.particle_batch(d, "user_id", "event_id", "value", "se", particles=500, process_sd=0.5)
