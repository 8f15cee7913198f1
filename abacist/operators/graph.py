"""Networks on edge tables, and spatial weights and statistics on neighbour tables."""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import num
from abacist.operators import search
from abacist.operators.core import DataInsufficient, spread
from abacist.operators.panel import discard, written


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, out_weight, in_weight) of edges (src, dst, w)."""
    o = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("w").alias("ow"), F.lit(0.0).alias("iw"))
    i = edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0.0).alias("ow"), F.col("w").alias("iw"))
    return o.unionByName(i).groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("ow").alias("out_weight"), F.sum("iw").alias("in_weight"))


def density(edges: DataFrame) -> dict[str, float]:
    e = edges.where("src <> dst").select("src", "dst").distinct()
    n = e.select(F.col("src").alias("v")).unionByName(e.select(F.col("dst").alias("v"))).distinct().count()
    m = e.count()
    back = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").count()
    return {"nodes": float(n), "edges": float(m), "density": m / (n * (n - 1)), "reciprocity": back / m}


def pagerank(edges: DataFrame, damping: float = 0.85, tol: float = 1e-10, most: int = 200) -> DataFrame:
    """(node, rank) summing to 1; nodes without out-links share their rank among all."""
    spark = edges.sparkSession
    e = written(edges.groupBy("src", "dst").agg(F.sum("w").alias("w")), spark)
    nodes = written(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct(), spark)
    n = nodes.count()
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = written(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), spark)
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    sinks = written(nodes.join(out, nodes["node"] == out["src"], "left_anti"), spark)
    for _ in range(most):
        lost = rank.join(sinks, "node", "left_semi").agg(F.sum("rank")).first()[0] or 0.0
        flow = e.join(rank, e["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("f"))
        new = nodes.join(flow, nodes["node"] == flow["dst"], "left").select("node", ((1 - damping) / n + damping * (F.coalesce("f", F.lit(0.0)) + lost / n)).alias("rank"))
        new = written(new, spark)
        moved = new.join(rank.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = new
        if moved < tol:
            break
    else:
        raise DataInsufficient(f"ranks did not settle in {most} rounds")
    total = rank.agg(F.sum("rank")).first()[0]
    return rank.withColumn("rank", F.col("rank") / total)


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) of the undirected simple graph, the lower node first; a task holds a bounded number of edges."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return spread(e, ["src", "dst"]).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles, degree, clustering) of the undirected simple graph.

    Edges point from lower to higher degree among the ``RANKED`` nodes of highest degree, to these from all others, and by node
    among the others: a node has at most ``RANKED`` or twice the edges by ``RANKED`` edges out, and no edge is joined to look its
    degrees up.  An edge carries the hashed set of its end's own neighbours, a byte for each of them: of two-paths only those
    whose closing edge the set does not rule out are shuffled and looked up.  The lists of neighbours are shuffled once for all.
    """
    spark = edges.sparkSession
    e = written(undirected(edges).select(F.col("src").alias("a"), F.col("dst").alias("b")), spark)
    deg = written(e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d")), spark)
    n = deg.count()
    least = deg.agg(F.percentile_approx("d", 1 - RANKED / n)).first()[0] if n > RANKED else 0
    rank = deg.where(F.col("d") > least)
    j = e.join(F.broadcast(rank.select(F.col("v").alias("a"), F.col("d").alias("da"))), "a", "left").join(F.broadcast(rank.select(F.col("v").alias("b"), F.col("d").alias("db"))), "b", "left")
    j = j.fillna(0, ["da", "db"])
    swap = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") > F.col("b")))
    o = j.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("v"), F.greatest("da", "db").alias("dv"))
    # two-paths v - u - w, v before w: the closing edge points from v to w
    two = o.join(_hashed_sets(o), F.col("v") == F.col("__v")).drop("__v")
    two = two.join(_lists(o), F.col("u") == F.col("__u")).select("u", "v", "dv", "words", F.inline("ws").alias("w", "dw"))
    two = two.where("(dv < dw or dv = dw and v < w)").where(f"({MASK} & words[cast(pmod(xxhash64(w), size(words)) as int)]) = {MASK}").select("u", "v", "w")
    tri = two.join(_lists(o).select("__u", F.col("ws.v").alias("ws")), F.col("v") == F.col("__u")).where("array_contains(ws, w)")
    per = tri.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    d = deg.join(per, deg["v"] == per["node"], "left").select(F.col("v").alias("node"), F.coalesce("triangles", F.lit(0)).alias("triangles"), F.col("d").alias("degree"))
    return d.withColumn("clustering", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


#: Nodes whose degrees are broadcast, to point edges at them.
RANKED = 100_000
#: Four of a word's 64 bits, by the node's hash.
MASK = "(" + " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(w), {by}) & 63L as int))" for by in (58, 52, 46, 40)) + ")"


def _lists(o: DataFrame) -> DataFrame:
    """(__u, ws): the other columns of a node's rows in one list; the same plan wherever it is used, so that its shuffle is too."""
    return o.groupBy(F.col("u").alias("__u")).agg(F.collect_list(F.struct(*[c for c in o.columns if c != "u"])).alias("ws"))


def _hashed_sets(o: DataFrame) -> DataFrame:
    """(__v, words): the hashed set of ``v`` of each ``u``, a 64-bit word for every eight of them; a node without has no row."""
    out = _lists(o).select(F.col("__u").alias("__v"), F.col("ws.v").alias("ws")).withColumn("m", F.ceil(F.size("ws") / 8).cast("int"))
    bits = out.select("__v", F.expr(f"explode(concat(transform(ws, w -> struct(cast(pmod(xxhash64(w), m) as int) as slot, {MASK} as word)), transform(sequence(0, m - 1), s -> struct(s as slot, 0L as word)))) as x"))
    words = bits.groupBy("__v", F.col("x.slot").alias("slot")).agg(F.bit_or("x.word").alias("word"))
    return words.groupBy("__v").agg(F.sort_array(F.collect_list(F.struct("slot", "word"))).alias("x")).select("__v", F.col("x.word").alias("words"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; alternating star contractions over written rounds."""
    spark = edges.sparkSession
    e = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), spark)
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            alone = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
            return alone.join(e, alone["node"] == e["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        e = written(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(), spark)


def assortativity(edges: DataFrame, attribute: DataFrame) -> float:
    """Correlation of a node attribute (node, x) across edges, both directions."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    a = attribute.select(F.col("node").alias("src"), F.col("x").alias("xs"))
    b = attribute.select(F.col("node").alias("dst"), F.col("x").alias("xd"))
    return both.join(a, "src").join(b, "dst").agg(F.corr("xs", "xd")).first()[0]


def exposure(edges: DataFrame, treated: DataFrame) -> DataFrame:
    """(node, share, count): treated neighbours of each node with (node, t)."""
    t = treated.select(F.col("node").alias("dst"), num("t").alias("t"))
    return edges.join(t, "dst").groupBy(F.col("src").alias("node")).agg(F.avg("t").alias("share"), F.sum("t").alias("count"))


# ---------------------------------------------------------------- spatial
def distance_band(points: DataFrame, radius: float, row_standardise: bool = False) -> DataFrame:
    """(i, j, w) of pairs within the radius: an equality join over square cells of the radius's width and their neighbours."""
    p = points.select("id", num("x").alias("x"), num("y").alias("y")).dropna()
    cx, cy = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    around = F.explode(F.array(*[F.struct((cx + a).alias("cx"), (cy + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    left = p.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), around.alias("c"))
    right = p.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.struct(cx.alias("cx"), cy.alias("cy")).alias("c"))
    gap = F.hypot(F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj"))
    w = left.join(right, "c").where((F.col("i") != F.col("j")) & (gap <= radius)).select("i", "j", F.lit(1.0).alias("w"))
    return standardised(w) if row_standardise else w


def standardised(w: DataFrame) -> DataFrame:
    total = w.groupBy("i").agg(F.sum("w").alias("__t"))
    return w.join(total, "i").select("i", "j", (F.col("w") / F.col("__t")).alias("w"))


def spatial_lag(w: DataFrame, values: DataFrame) -> DataFrame:
    """(id, lag): the weighted sum of neighbours' values (id, v)."""
    return w.join(values.select(F.col("id").alias("j"), "v"), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("lag"))


def _centred(w: DataFrame, values: DataFrame):
    v = values.select("id", num("v").alias("v")).dropna()
    n, m = v.agg(F.count("*"), F.avg("v")).first()
    z = v.select("id", (F.col("v") - m).alias("z"))
    j = w.join(z.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
    return n, z, j


def moran(w: DataFrame, values: DataFrame) -> dict[str, float]:
    """Moran's I with its expectation and variance under randomisation."""
    n, z, j = _centred(w, values)
    m2, m4 = z.agg(F.sum(F.col("z") ** 2), F.sum(F.col("z") ** 4)).first()
    s0, cross = j.agg(F.sum("w"), F.sum(F.col("w") * F.col("zi") * F.col("zj"))).first()
    back = w.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("b"))
    s1 = w.join(back, ["i", "j"], "full").agg(F.sum((F.coalesce("w", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) ** 2)).first()[0] / 2
    rows = w.select(F.col("i").alias("k"), "w").unionByName(w.select(F.col("j").alias("k"), "w")).groupBy("k").agg(F.sum("w").alias("s"))
    s2 = rows.agg(F.sum(F.col("s") ** 2)).first()[0]
    i, e, b2 = n / s0 * cross / m2, -1 / (n - 1), m4 / n / (m2 / n) ** 2
    a = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)
    c = b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    v = (a - c) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - e * e
    zscore = (i - e) / math.sqrt(v)
    return {"moran": i, "expected": e, "variance": v, "z": zscore, "p_value": dist.two_sided(zscore)}


def geary(w: DataFrame, values: DataFrame) -> float:
    n, z, j = _centred(w, values)
    m2 = z.agg(F.sum(F.col("z") ** 2)).first()[0]
    s0, gap = j.agg(F.sum("w"), F.sum(F.col("w") * (F.col("zi") - F.col("zj")) ** 2)).first()
    return (n - 1) * gap / (2 * s0 * m2)


def local_moran(w: DataFrame, values: DataFrame) -> DataFrame:
    """(id, local, quadrant) of each unit with neighbours."""
    n, z, j = _centred(w, values)
    m2 = z.agg(F.sum(F.col("z") ** 2)).first()[0] / n
    lag = j.groupBy("i", "zi").agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    q = F.when((F.col("zi") > 0) & (F.col("lag") > 0), "HH").when((F.col("zi") <= 0) & (F.col("lag") <= 0), "LL").when(F.col("zi") > 0, "HL").otherwise("LH")
    return lag.select(F.col("i").alias("id"), (F.col("zi") * F.col("lag") / m2).alias("local"), q.alias("quadrant"))


def getis_ord(w: DataFrame, values: DataFrame) -> float:
    """General G of positive values."""
    v = values.select("id", num("v").alias("v")).dropna()
    s, q = v.agg(F.sum("v"), F.sum(F.col("v") ** 2)).first()
    j = w.join(v.select(F.col("id").alias("i"), F.col("v").alias("vi")), "i").join(v.select(F.col("id").alias("j"), F.col("v").alias("vj")), "j")
    return j.agg(F.sum(F.col("w") * F.col("vi") * F.col("vj"))).first()[0] / (s * s - q)


def conley_meat(d: DataFrame, scores: list, x: str, y: str, radius: float):
    """Sum over pairs within the radius of products of scores (Bartlett weights), by cells."""
    import numpy as np

    k = len(scores)
    base = d.select(F.monotonically_increasing_id().alias("id"), num(x).alias("x"), num(y).alias("y"), *[s.alias(f"s{i}") for i, s in enumerate(scores)])
    p = written(base, d.sparkSession)
    cx, cy = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    around = F.explode(F.array(*[F.struct((cx + a).alias("cx"), (cy + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    left = p.select(F.col("x").alias("xi"), F.col("y").alias("yi"), *[F.col(f"s{i}").alias(f"a{i}") for i in range(k)], around.alias("c"))
    right = p.select(F.col("x").alias("xj"), F.col("y").alias("yj"), *[F.col(f"s{i}").alias(f"b{i}") for i in range(k)], F.struct(cx.alias("cx"), cy.alias("cy")).alias("c"))
    gap = F.hypot(F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj"))
    j = left.join(right, "c").where(gap <= radius).withColumn("w", 1 - gap / radius)
    row = j.agg(*[F.sum(F.col("w") * F.col(f"a{p_}") * F.col(f"b{q}")) for p_ in range(k) for q in range(k)]).first()
    return np.array(row).reshape(k, k)


def modularity(edges: DataFrame, community: DataFrame) -> float:
    """Newman's modularity of an undirected weighted graph; ``community`` is (node, c), edges are listed once."""
    c = community.select("node", "c")
    e = edges.select("src", "dst", F.col("w").cast("double").alias("w") if "w" in edges.columns else F.lit(1.0).alias("w"))
    e = e.join(c.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(c.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst")
    inside = F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)
    # each edge counts at both its ends, so that one pass gives all sums
    ends = e.select(F.explode(F.array("cs", "cd")).alias("c"), "w", inside.alias("i")).groupBy("c").agg(F.sum("w").alias("k"), F.sum("i").alias("i"))
    twice, within, squares = ends.agg(F.sum("k"), F.sum("i"), F.sum(F.col("k") ** 2)).first()
    return within / twice - squares / (twice * twice)


def core_numbers(edges: DataFrame) -> DataFrame:
    """(node, core): the largest k whose k-core holds the node; each peeling is a written table, and a round starts at the least degree left."""
    spark = edges.sparkSession
    u = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    s = written(u.unionByName(u.select(F.col("b").alias("a"), F.col("a").alias("b"))), spark)
    done, k = [], 0
    while True:
        degree = written(s.groupBy("a").agg(F.count("*").alias("n")), spark)
        least = degree.agg(F.min("n")).first()[0]
        if least is None:
            break
        k = max(k, least)
        weak = degree.where(F.col("n") <= k).select("a")
        left = written(s.join(weak, "a", "left_anti").join(weak.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b"), spark)
        # nodes that lost all their links to the peeled ones go with them
        done.append(degree.select("a").join(left.select("a").distinct(), "a", "left_anti").select(F.col("a").alias("node"), F.lit(k).alias("core")))
        s = left
    return reduce(DataFrame.unionByName, done) if done else s.select(F.col("a").alias("node"), F.lit(0).alias("core"))


def _walk(edges: DataFrame, step, start: float, tol: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Repeat ``step(edges, scores)`` until no score moves by ``tol``, or raise; scores are (node, x), each round is a written table."""
    spark = edges.sparkSession
    e = written(edges.groupBy("src", "dst").agg(F.sum("w").alias("w")), spark)
    x = written(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().withColumn("x", F.lit(start)), spark)
    for _ in range(most):
        new = written(step(e, x), spark)
        moved = new.join(x.withColumnRenamed("x", "old"), "node").agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0]
        x = new
        if moved is None or moved < tol:
            return e, x
    raise DataInsufficient(f"scores did not settle in {most} rounds")


def _pulled(e: DataFrame, x: DataFrame, along: str = "src", to: str = "dst") -> DataFrame:
    """(node, x): weighted sums over in-links of the scores at their other end; 0 without any."""
    s = e.join(x.withColumnRenamed("node", along), along).groupBy(F.col(to).alias("__to")).agg(F.sum(F.col("w") * F.col("x")).alias("__s"))
    return x.select("node").join(s, F.col("node") == F.col("__to"), "left").select("node", F.coalesce("__s", F.lit(0.0)).alias("x"))


def _scaled(x: DataFrame) -> DataFrame:
    norm = x.agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("__norm"))
    return x.crossJoin(F.broadcast(norm)).select("node", F.when(F.col("__norm") > 0, F.col("x") / F.col("__norm")).otherwise(0.0).alias("x"))  # one row


def eigenvector_centrality(edges: DataFrame, tol: float = 1e-9, most: int = 200) -> DataFrame:
    """(node, x) of unit length over in-links; a node's own score is added in each step, which keeps bipartite graphs from swinging."""

    def step(e, x):
        return _scaled(_pulled(e, x).join(x.withColumnRenamed("x", "own"), "node").select("node", (F.col("x") + F.col("own")).alias("x")))

    return _walk(edges, step, 1.0, tol, most)[1]


def katz_centrality(edges: DataFrame, alpha: float = 0.01, tol: float = 1e-9, most: int = 200) -> DataFrame:
    """(node, x) of unit length; walks of each length count by powers of ``alpha``, below the inverse of the largest eigenvalue."""
    return _scaled(_walk(edges, lambda e, x: _pulled(e, x).select("node", (1 + alpha * F.col("x")).alias("x")), 1.0, tol, most)[1])


def hits(edges: DataFrame, tol: float = 1e-9, most: int = 200) -> DataFrame:
    """(node, hub, authority), each of unit length."""
    e, a = _walk(edges, lambda e, x: _scaled(_pulled(e, _pulled(e, x, "dst", "src"))), 1.0, tol, most)
    h = _scaled(_pulled(e, a, "dst", "src"))
    return h.withColumnRenamed("x", "hub").join(a.withColumnRenamed("x", "authority"), "node")


def _words(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(word, nodes): ``sources`` dealt to words of at most 64, each of one component; a source's bit is its place in ``nodes``.

    Lists come from small groups by hash, so no task holds a component.
    """
    part = connected(edges.select("src", "dst"))
    own = sources.select("node").dropna().distinct().join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    many = own.groupBy("component").agg(F.ceil(F.count("*") / 48).alias("m"))
    dealt = own.join(many, "component").groupBy("component", F.pmod(F.xxhash64("node"), F.col("m")).alias("h")).agg(F.collect_list("node").alias("ns"))
    cut = dealt.select(F.explode(F.transform(F.sequence(F.lit(0), F.expr("cast((size(ns) - 1) div 64 as int)")), lambda i: F.slice("ns", i * 64 + 1, 64))).alias("nodes"))
    return written(cut.select(F.monotonically_increasing_id().alias("word"), "nodes"), edges.sparkSession)


def _bit_levels(edges: DataFrame, words: DataFrame):
    """Written tables (word, node, bits), one a level: ``node`` is reached first at this level by the word's sources in ``bits``.

    All sources search at once, a level a round.  The bits seen so far are one table, which each round replaces.
    """
    spark = edges.sparkSession
    e = written(edges.select("src", "dst").distinct(), spark)
    bit = F.expr("shiftleft(1L, at)")
    edge = written(words.select("word", F.posexplode("nodes").alias("at", "node")).select("word", "node", bit.alias("bits")), spark)
    seen = written(edge, spark)
    while not edge.isEmpty():
        yield edge
        near = edge.join(e, edge["node"] == e["src"]).groupBy("word", F.col("dst").alias("node")).agg(F.bit_or("bits").alias("near"))
        both = written(seen.join(near, ["word", "node"], "full").select("word", "node", F.coalesce("bits", F.lit(0)).alias("old"), F.coalesce("near", F.lit(0)).alias("near")), spark)
        discard(seen)
        fresh = F.col("near").bitwiseAND(F.bitwise_not("old"))
        edge = written(both.select("word", "node", fresh.alias("bits")).where("bits <> 0"), spark)
        seen = written(both.select("word", "node", F.col("old").bitwiseOR(F.col("near")).alias("bits")), spark)
        discard(both)
    discard(seen)


def _by_component(edges: DataFrame, sources: DataFrame) -> tuple[str, DataFrame, DataFrame | None, DataFrame | None]:
    """(type of a node, what ``search.dealt`` gives)."""
    spark = edges.sparkSession
    e = written(edges.select("src", "dst").dropna().distinct(), spark)
    own = written(sources.select("node").dropna().distinct(), spark)
    kind = e.select("src").union(e.select("dst")).union(own).schema[0].dataType.simpleString()
    return kind, *search.dealt(e, written(connected(e), spark), own)


def path_lengths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, steps): links on the shortest directed path from each of ``sources`` (node); unreachable nodes have no row.

    Components are searched within tasks, pair by pair as the result is read; those of over ``search.BOUND`` links in rounds over
    tables, where levels stay as bits by word of sources.
    """
    kind, rows, links, far = _by_component(edges, sources)
    near = search.by_bin(rows, search.lengths, f"source {kind}, node {kind}, steps int")
    return near if links is None else near.unionByName(_far_lengths(links, far))


def _far_lengths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    words = _words(edges, sources)
    levels = [t.select("word", "node", "bits", F.lit(k).alias("steps")) for k, t in enumerate(_bit_levels(edges, words))]
    met = reduce(DataFrame.unionByName, levels).join(words, "word").select("bits", "node", "steps", F.posexplode("nodes").alias("at", "source"))
    return met.where("shiftrightunsigned(bits, at) & 1L = 1L").select("source", "node", "steps")


def counted_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, steps, paths): shortest directed paths from each of ``sources`` (node) and how many there are.

    All sources search at once, a level of nodes a round, until no node is new.  A round joins the last level only, and
    looks for its nodes among those that were seen.
    """
    spark = edges.sparkSession
    e = written(edges.select("src", "dst").distinct(), spark)
    edge = written(sources.select(F.col("node").alias("source"), "node").distinct().select("*", F.lit(0).alias("steps"), F.lit(1.0).alias("paths")), spark)
    levels, k = [edge], 0
    while not edge.isEmpty():
        k += 1
        near = edge.join(e, edge["node"] == e["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        for seen in levels:
            near = near.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        edge = written(near.select("source", "node", F.lit(k).alias("steps"), "paths"), spark)
        # not a table of its own for every level
        if len(levels) < 4:
            levels = [*levels, edge]
        else:
            old, levels = levels, [written(reduce(DataFrame.unionByName, levels), spark), edge]
            for t in old:
                discard(t)
    return reduce(DataFrame.unionByName, levels)


def betweenness_centrality(edges: DataFrame, sources: DataFrame | None = None, *, normalised: bool = False) -> DataFrame:
    """(node, betweenness): over pairs of other nodes, the share of their shortest directed paths that pass through the node.

    Paths are counted from all ``sources`` (node; by default every node); then shares run back from the farthest level.
    Components are searched within tasks, for a block of sources at a time, and only sums by node leave them; those of over
    ``search.BOUND`` links in rounds over tables of pairs.  ``normalised`` divides by the number of ordered pairs of other nodes.
    """
    spark = edges.sparkSession
    e = written(edges.where("src <> dst").select("src", "dst").distinct(), spark)
    nodes = written(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), spark)
    kind, rows, links, far = _by_component(e, nodes if sources is None else sources)
    share = search.by_bin(rows, search.shares, f"node {kind}, share double")
    if links is not None:
        share = share.unionByName(_far_shares(links, far))
    total = share.groupBy(F.col("node").alias("__n")).agg(F.sum("share").alias("__b"))
    n = nodes.count()
    scale = 1.0 / max((n - 1) * (n - 2), 1) if normalised else 1.0
    return nodes.join(total, F.col("node") == F.col("__n"), "left").select("node", (F.coalesce("__b", F.lit(0.0)) * scale).alias("betweenness"))


def _far_shares(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, share) by source and level."""
    spark = e.sparkSession
    p = written(counted_paths(e, sources), spark)
    depth = p.agg(F.max("steps")).first()[0] or 0
    share, rounds = None, []
    for k in range(depth, 0, -1):
        far = p.where(F.col("steps") == k).select("source", F.col("node").alias("dst"), F.col("paths").alias("__to"))
        far = far.withColumn("__d", F.lit(0.0)) if share is None else far.join(share.select("source", F.col("node").alias("dst"), F.col("share").alias("__got")), ["source", "dst"], "left").withColumn("__d", F.coalesce("__got", F.lit(0.0)))
        near = p.where(F.col("steps") == k - 1).select("source", F.col("node").alias("src"), F.col("paths").alias("__from"))
        back = far.join(e, "dst").join(near, ["source", "src"])
        share = written(back.groupBy("source", F.col("src").alias("node")).agg(F.sum(F.col("__from") / F.col("__to") * (1 + F.col("__d"))).alias("share")), spark)
        rounds.append(share)
    none = sources.where("false").select("node", F.lit(0.0).alias("share"))
    return reduce(DataFrame.unionByName, [r.where("node <> source").select("node", "share") for r in rounds], none)


def communities(edges: DataFrame, *, resolution: float = 1.0, rounds: int = 100) -> DataFrame:
    """(node, community): local moves that raise modularity, then the same on the graph of communities, until nothing rises.

    Links count in both directions.  No community spans two components, so these are dealt to tasks: there each node in turn
    weighs the communities of its neighbours by the links it has there against what chance would give, and moves to the best
    if that gains.  Components of over ``search.BOUND`` links move in at most ``rounds`` rounds a level over tables.
    A community is named by its smallest node.
    """
    spark = edges.sparkSession
    one_way = edges.select("src", "dst", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w")).dropna()
    both = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    e = written(both.groupBy("src", "dst").agg(F.sum("w").alias("w")), spark)
    total = e.agg(F.sum("w")).first()[0]
    if not total:
        return e.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct()
    rows, links, _ = search.dealt(e, written(connected(e), spark))
    kind = e.schema["src"].dataType.simpleString()
    near = search.by_bin(rows, partial(search.louvain, total=total, resolution=resolution), f"node {kind}, community {kind}")
    return near if links is None else near.unionByName(_far_communities(links, total, resolution, rounds))


def _far_communities(edges: DataFrame, total: float, resolution: float, rounds: int) -> DataFrame:
    """(node, community) by rounds over tables; ``edges`` are listed in both directions, ``total`` is the weight of all of the graph.

    Of the nodes that want to move in a round those drawn by hash do, so that neighbours do not keep trading places, and a round
    that does not raise modularity is drawn anew; beyond ``rounds`` of one level an error says so.
    """
    spark = edges.sparkSession
    e = written(edges, spark)
    names = written(e.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("community")), spark)

    def weighed(e: DataFrame, at: DataFrame) -> tuple[DataFrame, float, bool]:
        """(node, k, c, best community, whether it wants to go there), modularity of ``at``, whether any does; ``e`` has the degree ``k`` of src."""
        size = at.groupBy("c").agg(F.sum("k").alias("size"))
        at = at.join(size, "c").select("node", "k", "c", "size")
        links = e.join(at.select(F.col("node").alias("dst"), "c", "size"), "dst").select(F.col("src").alias("node"), "k", "c", "size", F.col("w").alias("to"), F.lit(False).alias("stay"))
        # a node's own community without itself, which it may have no link to
        every = links.unionByName(at.select("node", "k", "c", "size", F.lit(0.0).alias("to"), F.lit(True).alias("stay")))
        every = every.groupBy("node", "c").agg(F.max("k").alias("k"), F.max("size").alias("size"), F.sum("to").alias("to"), F.max("stay").alias("stay"))
        gain = F.col("to") - resolution * F.col("k") * (F.col("size") - F.when(F.col("stay"), F.col("k")).otherwise(0.0)) / total
        own = F.struct("gain", "c", "to", "size")
        pick = every.withColumn("gain", gain).groupBy("node").agg(F.max("k").alias("k"), F.max(F.struct("gain", "stay", "c")).alias("b"), F.max(F.when(F.col("stay"), own)).alias("own"))
        wants = F.col("b.gain") > F.col("own.gain") + 1e-12 * total
        t = written(pick.select("node", "k", F.col("own.c").alias("c"), F.col("b.c").alias("best"), wants.alias("wants"), F.col("own.to").alias("to"), F.col("own.size").alias("size")), spark)
        inside, squares, some = t.agg(F.sum("to"), F.sum(F.col("k") * F.col("size")), F.max("wants")).first()
        return t, inside / total - resolution * squares / total**2, bool(some)

    def moved(r: int):
        """Community of each row of ``weighed`` after the draw of round ``r``."""
        return F.when(F.col("wants") & (F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0), F.col("best")).otherwise(F.col("c"))

    def scores(e: DataFrame, t: DataFrame, draws: list[int]) -> list[float]:
        """Modularity after each of the draws, in one job."""
        at = t.select("node", "k", F.array(*[moved(r) for r in draws]).alias("c"))
        both = e.join(at.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(at.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst")
        inside = both.agg(F.array(*[F.sum(F.when(F.col("cs")[i] == F.col("cd")[i], F.col("w")).otherwise(0.0)) for i in range(len(draws))]).alias("inside"))
        sizes = at.select("k", F.posexplode("c").alias("i", "c")).groupBy("i", "c").agg(F.sum("k").alias("k"))
        squares = sizes.agg(F.array(*[F.sum(F.when(F.col("i") == i, F.col("k") ** 2).otherwise(0.0)) for i in range(len(draws))]).alias("squares"))
        inside, squares = inside.crossJoin(squares).first()  # a row each
        # links of a node to itself do not change
        return [(a + alone) / total - resolution * q / total**2 for a, q in zip(inside, squares)]

    def local(e: DataFrame) -> tuple[DataFrame, bool]:
        nonlocal alone
        degree = written(e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), spark)
        alone = e.where("src = dst").agg(F.sum("w")).first()[0] or 0.0
        e = written(e.where("src <> dst").join(degree.withColumnRenamed("node", "src"), "src"), spark)
        t, best, some = weighed(e, degree.select("node", "k", F.col("node").alias("c")))
        best, rose, r = best + alone / total, False, 0
        while r < rounds:
            if not some:
                return t, rose
            after, new, more = weighed(e, t.select("node", "k", moved(r).alias("c")))
            new, r = new + alone / total, r + 1
            if new <= best + 1e-12:
                # nine more draws: if none rises, what single nodes gain, they lose together
                draws = list(range(r, min(r + 9, rounds)))
                rises = [i for i, v in zip(draws, scores(e, t, draws) if draws else []) if v > best + 1e-12]
                if not rises:
                    if len(draws) < 9:
                        break
                    return t, rose
                r = rises[0] + 1
                after, new, more = weighed(e, t.select("node", "k", moved(rises[0]).alias("c")))
                new += alone / total
            t, best, some, rose = after, new, more, True
        raise DataInsufficient(f"communities did not settle in {rounds} rounds")

    alone = 0.0
    while True:
        at, rose = local(e)
        if not rose:
            break
        at = written(at.select("node", "c"), spark)
        names = written(names.join(at.select(F.col("node").alias("community"), "c"), "community").select("node", F.col("c").alias("community")), spark)
        to = at.select(F.col("node").alias("dst"), F.col("c").alias("__d"))
        e = written(e.join(at.select(F.col("node").alias("src"), F.col("c").alias("__s")), "src").join(to, "dst").groupBy(F.col("__s").alias("src"), F.col("__d").alias("dst")).agg(F.sum("w").alias("w")), spark)
    first = names.groupBy("community").agg(F.min("node").alias("first"))
    return names.join(first, "community").select("node", F.col("first").alias("community"))


def closeness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, closeness) of ``sources`` by outgoing paths, scaled by the share of nodes they reach; a node that reaches none has no row."""
    n = edges.select(F.explode(F.array("src", "dst")).alias("v")).agg(F.count_distinct("v")).first()[0]
    kind, rows, links, far = _by_component(edges, sources)
    per = search.by_bin(rows, search.reaches, f"node {kind}, r long, s long")
    if links is not None:
        per = per.unionByName(_far_reaches(links, far))
    return per.where("r > 0").select("node", (F.col("r") / F.col("s") * F.col("r") / (n - 1)).alias("closeness"))


def _far_reaches(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, r, s): how many other nodes each source reaches, and its steps to them in all."""
    spark, words, levels = edges.sparkSession, _words(edges, sources), []
    for k, t in enumerate(_bit_levels(edges, words)):
        if k:  # how many nodes each of a word's sources reaches at this level
            counts = F.array(*[F.sum(F.expr(f"shiftrightunsigned(bits, {i}) & 1L")) for i in range(64)])
            levels.append(written(t.groupBy("word").agg(counts.alias("counts")).select("word", "counts", F.lit(k).alias("steps")), spark))
            discard(before)
        before = t
    if not levels:
        return sources.where("false").select("node", F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("s"))
    per = reduce(DataFrame.unionByName, levels).select("word", "steps", F.posexplode("counts").alias("at", "m")).where("m > 0")
    per = per.groupBy("word", "at").agg(F.sum("m").alias("r"), F.sum(F.col("m") * F.col("steps")).alias("s"))
    return words.select("word", F.posexplode("nodes").alias("at", "node")).join(per, ["word", "at"]).select("node", "r", "s")


def transitivity(edges: DataFrame) -> float:
    """Closed triples over all triples."""
    t, d = triangles(edges).agg(F.sum("triangles"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2)).first()
    return t / d if d else 0.0


def rook(grid: DataFrame, queen: bool = False) -> DataFrame:
    """(i, j, w) of neighbours on an integer grid (id, x, y): shared edges, or corners too; an equality join per direction."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (queen or not a or not b)]
    around = F.explode(F.array(*[F.struct((F.col("x") + a).cast("long").alias("x"), (F.col("y") + b).cast("long").alias("y")) for a, b in steps]))
    left = grid.select(F.col("id").alias("i"), around.alias("at"))
    right = grid.select(F.col("id").alias("j"), F.struct(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).alias("at"))
    return left.join(right, "at").select("i", "j", F.lit(1.0).alias("w"))


def join_counts(w: DataFrame, values: DataFrame) -> dict[str, float]:
    """Weights of neighbour pairs that are both 1, both 0 or mixed (each pair once), of 0/1 values (id, v)."""
    a, b = (values.select(F.col("id").alias(c), num("v").alias(f"v{c}")) for c in "ij")
    j = w.join(a, "i").join(b, "j")
    both = F.col("vi") * F.col("vj")
    r = j.agg(F.sum(F.col("w") * both) / 2, F.sum(F.col("w") * (1 - F.col("vi")) * (1 - F.col("vj"))) / 2, F.sum(F.col("w") * (F.col("vi") - F.col("vj")) ** 2) / 2).first()
    return {"bb": r[0] or 0.0, "ww": r[1] or 0.0, "bw": r[2] or 0.0}


def local_getis(w: DataFrame, values: DataFrame) -> DataFrame:
    """(id, z): standardised local G of each unit's neighbours, itself left out."""
    v = values.select("id", num("v").alias("v")).dropna()
    n, s, q = v.agg(F.count("*"), F.sum("v"), F.sum(F.col("v") ** 2)).first()
    near = w.join(v.select(F.col("id").alias("j"), F.col("v").alias("vj")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("vj")).alias("g"), F.sum("w").alias("k"), F.sum(F.col("w") ** 2).alias("k2"))
    j = near.join(v.select(F.col("id").alias("i"), "v"), "i")
    m = (s - F.col("v")) / (n - 1)
    sd = F.sqrt((q - F.col("v") ** 2) / (n - 1) - m * m)
    return j.select(F.col("i").alias("id"), ((F.col("g") - F.col("k") * m) / (sd * F.sqrt(((n - 1) * F.col("k2") - F.col("k") ** 2) / (n - 2)))).alias("z"))
