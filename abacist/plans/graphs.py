"""Queries of networks, space, streams, sources and generated data."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.operators import causal, did, graph
from abacist.operators.core import spread
from abacist.plans.registry import Tables, one, query
from abacist.sources import io, simulate
from abacist.streaming import folds

EDGES = "SELECT c_nationkey AS src, s_nationkey AS dst, count(*)::DOUBLE AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"


def _edges(t: Tables):
    """Trade: lines that customers of one nation bought from suppliers of another."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("w"))


PAIRS = "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey"


def _met(t: Tables):
    """Parts bought together: in one order, as often as they are."""
    lines = spread(t.lineitem.select("l_orderkey", "l_partkey"), ["l_orderkey"])
    a, b = (lines.select("l_orderkey", F.col("l_partkey").alias(c)) for c in ("src", "dst"))
    return a.join(b, "l_orderkey").where("src < dst").select("src", "dst")


def _pairs(t: Tables):
    """Parts bought together, each pair once."""
    return graph.undirected(_met(t))


@query("network_degrees", f"WITH e AS ({EDGES}), b AS (SELECT src AS node, 1 o, 0 i, w ow, 0 iw FROM e UNION ALL SELECT dst, 0, 1, 0, w FROM e) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(ow)::DOUBLE AS out_weight, sum(iw)::DOUBLE AS in_weight FROM b GROUP BY 1")
def _(t):
    return graph.degrees(_edges(t))


@query("network_density", f"WITH e AS (SELECT DISTINCT src, dst FROM ({EDGES}) WHERE src <> dst), n AS (SELECT count(DISTINCT v) n FROM (SELECT src v FROM e UNION ALL SELECT dst FROM e)), r AS (SELECT count(*) r FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src) SELECT n::DOUBLE AS nodes, (SELECT count(*) FROM e)::DOUBLE AS edges, round((SELECT count(*) FROM e)/(n*(n-1)), 8) AS density, round(r/(SELECT count(*) FROM e), 8) AS reciprocity FROM n, r", 8)
def _(t):
    return one(t.spark, graph.density(_edges(t)))


@query("pagerank", f"""WITH RECURSIVE e AS ({EDGES}), nodes AS (SELECT src AS v FROM e UNION SELECT dst FROM e), n AS (SELECT count(*)::DOUBLE n FROM nodes), o AS (SELECT src, sum(w) t FROM e GROUP BY 1), p AS (SELECT e.src, e.dst, e.w/o.t AS p FROM e JOIN o USING (src)),
m AS (SELECT a.v AS src, b.v AS dst, 0.15/n + 0.85*(CASE WHEN o.src IS NULL THEN 1/n ELSE coalesce(p.p, 0) END) AS g FROM nodes a CROSS JOIN nodes b CROSS JOIN n LEFT JOIN o ON o.src = a.v LEFT JOIN p ON p.src = a.v AND p.dst = b.v),
r AS (SELECT 0 AS k, v, 1/n AS x FROM nodes, n UNION ALL SELECT k, v, x FROM (SELECT r.k + 1 AS k, m.dst AS v, sum(r.x*m.g) AS x FROM r JOIN m ON r.v = m.src WHERE r.k < 120 GROUP BY r.k, m.dst))
SELECT v AS node, round(x, 7) AS rank FROM r WHERE k = 120""", 7)
def _(t):
    return graph.pagerank(_edges(t))


UNDIRECTED = "u AS (SELECT DISTINCT least(src, dst) a, greatest(src, dst) b FROM ({edges}) WHERE src <> dst), s AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u)"
REGIONAL = f"SELECT src, dst FROM ({EDGES}) JOIN nation x ON x.n_nationkey = src JOIN nation y ON y.n_nationkey = dst WHERE x.n_regionkey = y.n_regionkey"


@query("triangles", f"WITH {UNDIRECTED.format(edges=PAIRS)}, d AS (SELECT a AS node, count(*) degree FROM s GROUP BY 1), t AS (SELECT x.a AS node, count(*) AS n FROM s x JOIN s y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY 1) SELECT node, coalesce(n, 0) AS triangles, degree, round(CASE WHEN degree > 1 THEN 2*coalesce(n, 0)/(degree*(degree-1)) ELSE 0 END, 8) AS clustering FROM d LEFT JOIN t USING (node)", 8)
def _(t):
    return graph.triangles(_met(t))  # which takes each pair once


@query("components", f"WITH RECURSIVE {UNDIRECTED.format(edges=REGIONAL)}, r AS (SELECT a AS node, a AS root FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY 1")
def _(t):
    x, y = (t.nation.select(F.col("n_nationkey").alias(c), F.col("n_regionkey").alias(f"r_{c}")) for c in ("src", "dst"))
    return graph.connected(_edges(t).join(x, "src").join(y, "dst").where("r_src = r_dst and src <> dst"))


@query("assortativity", f"WITH e AS ({EDGES}), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) SELECT round(corr(x.n_regionkey, y.n_regionkey), 8) AS r FROM b JOIN nation x ON x.n_nationkey = src JOIN nation y ON y.n_nationkey = dst", 8)
def _(t):
    a = t.nation.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("x"))
    return one(t.spark, {"r": graph.assortativity(_edges(t), a)})


@query("network_exposure", f"WITH e AS ({EDGES}) SELECT src AS node, round(avg((n_regionkey = 1)::INT), 8) AS share, sum((n_regionkey = 1)::INT)::DOUBLE AS count FROM e JOIN nation ON dst = n_nationkey GROUP BY 1", 8)
def _(t):
    return graph.exposure(_edges(t), t.nation.select(F.col("n_nationkey").alias("node"), (F.col("n_regionkey") == 1).cast("int").alias("t")))


POINTS = "SELECT s_suppkey AS id, s_suppkey % 10 AS x, s_suppkey // 10 AS y, s_acctbal AS v FROM supplier"
NEAR = f"p AS ({POINTS}), w AS (SELECT a.id i, b.id j, 1.0 w FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 1.5)"


def _points(t: Tables):
    return t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10).alias("x"), F.floor(F.col("s_suppkey") / 10).alias("y"), F.col("s_acctbal").alias("v"))


@query("distance_band", f"WITH {NEAR} SELECT i, j, w::DOUBLE AS w FROM w")
def _(t):
    return graph.distance_band(_points(t), 1.5)


@query("spatial_lag", f"WITH {NEAR} SELECT i AS id, round(avg(v), 6) AS lag FROM w JOIN p ON p.id = j GROUP BY 1")
def _(t):
    return graph.spatial_lag(graph.distance_band(_points(t), 1.5, True), _points(t))


@query("moran", f"WITH {NEAR}, z AS (SELECT id, v - avg(v) OVER () AS z FROM p) SELECT round((SELECT count(*) FROM p)/sum(w)*sum(w*a.z*b.z)/(SELECT sum(z*z) FROM z), 8) AS moran, round(-1.0/((SELECT count(*) FROM p)-1), 8) AS expected FROM w JOIN z a ON a.id = i JOIN z b ON b.id = j", 8)
def _(t):
    r = graph.moran(graph.distance_band(_points(t), 1.5), _points(t))
    return one(t.spark, {k: r[k] for k in ("moran", "expected")})


@query("geary", f"WITH {NEAR}, z AS (SELECT id, v - avg(v) OVER () AS z FROM p) SELECT round(((SELECT count(*) FROM p)-1)*sum(w*(a.z-b.z)*(a.z-b.z))/(2*sum(w)*(SELECT sum(z*z) FROM z)), 8) AS geary FROM w JOIN z a ON a.id = i JOIN z b ON b.id = j", 8)
def _(t):
    return one(t.spark, {"geary": graph.geary(graph.distance_band(_points(t), 1.5), _points(t))})


@query("local_moran", f"WITH {NEAR}, z AS (SELECT id, v - avg(v) OVER () AS z FROM p), l AS (SELECT a.id, a.z, sum(b.z) lag FROM w JOIN z a ON a.id = i JOIN z b ON b.id = j GROUP BY 1, 2) SELECT id, round(z*lag/(SELECT avg(z*z) FROM z), 6) AS local, CASE WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z <= 0 AND lag <= 0 THEN 'LL' WHEN z > 0 THEN 'HL' ELSE 'LH' END AS quadrant FROM l")
def _(t):
    return graph.local_moran(graph.distance_band(_points(t), 1.5), _points(t))


@query("getis_ord", f"WITH {NEAR} SELECT round(sum(w*a.v*b.v)/((SELECT sum(v)*sum(v) - sum(v*v) FROM p)), 8) AS g FROM w JOIN p a ON a.id = i JOIN p b ON b.id = j", 8)
def _(t):
    return one(t.spark, {"g": graph.getis_ord(graph.distance_band(_points(t), 1.5), _points(t))})


# ---------------------------------------------------------------- batch twins of the streaming operators
@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(t):
    return folds.windowed(t.events, "ts", "value", ["event_type"], "1 hour").select("start", "event_type", "n", "total")


@query("sessions", "WITH d AS (SELECT user_id, ts, ts - lag(ts) OVER w >= INTERVAL 2 hour OR lag(ts) OVER w IS NULL AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) k FROM d) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(t):
    return folds.sessions(t.events, "ts", "user_id", "2 hours").select("user_id", "start", "n")


@query("windowed_effect", "SELECT time_bucket(INTERVAL 6 hour, ts) AS start, round(avg(value) FILTER (user_id % 2 = 1) - avg(value) FILTER (user_id % 2 = 0), 6) AS effect, count(*) FILTER (user_id % 2 = 1) AS n1, count(*) FILTER (user_id % 2 = 0) AS n0 FROM events GROUP BY 1")
def _(t):
    return folds.windowed_effect(t.events.withColumn("arm", F.col("user_id") % 2), "ts", "value", "arm", "6 hours").select("start", "effect", "n1", "n0")


@query("kalman", "SELECT user_id, event_id, round(sum(value/4) OVER w / (1 + count(*) OVER w / 4.0), 8) AS mean, round(1 / (1 + count(*) OVER w / 4.0), 8) AS variance FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", 8)
def _(t):
    return folds.kalman_batch(t.events.withColumn("se", F.lit(2.0)), "user_id", "event_id", "value", "se")


# ---------------------------------------------------------------- sources
@query("hash_sample")
def _(t):
    return io.sample(t.orders, 0.1, ["o_orderkey"]).select("o_orderkey")


@query("simulated_rct")
def _(t):
    d = simulate.rct(t.spark, of=t.orders.select(F.col("o_orderkey").alias("id")))
    return d.groupBy("treatment").agg(F.count("*").alias("n"), F.avg("y").alias("y"))


@query("simulated_staggered")
def _(t):
    return did.aggte(did.att_gt(simulate.staggered(t.spark, periods=9, of=t.supplier.select(F.col("s_suppkey").alias("id"))), "y", "first_treat", "unit", "time"), "dynamic")


@query("simulated_observational")
def _(t):
    return one(t.spark, causal.aipw(simulate.observational(t.spark, of=t.orders.select(F.col("o_orderkey").alias("id"))), "y", "treatment", ["x1", "x2"], "id"))
