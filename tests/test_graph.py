"""Searches and communities on graphs with long paths."""

import random
from collections import deque

import pytest
from abacist.operators import core, graph, panel
from abacist.operators.core import DataInsufficient
from pyspark.sql import functions as F


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double").repartition(3)


def test_path_of_many_nodes(spark):
    e = edges(spark, [(i, i + 1) for i in range(102)])
    got = {r.node: r.steps for r in graph.path_lengths(e, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: i for i in range(103)}


def brandes(nodes, out):
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order, q = {s: 0}, {s: 1.0}, [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in out.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] = paths.get(w, 0) + paths[v]
        delta = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in order:
                if w in out.get(v, ()) and dist[w] == dist[v] + 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return score


def test_betweenness_against_search_from_each_node(spark):
    rng = random.Random(4)
    pairs = {(i, i + 1) for i in range(14)} | {(rng.randrange(15), rng.randrange(15)) for _ in range(14)} | {(20, 21), (3, 3)}
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
    nodes = sorted({v for p in pairs for v in p if p[0] != p[1]})
    want = brandes(nodes, out)
    got = {r.node: r.betweenness for r in graph.betweenness_centrality(edges(spark, pairs)).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in nodes)
    n = len(nodes)
    scaled = {r.node: r.betweenness for r in graph.betweenness_centrality(edges(spark, pairs), normalised=True).collect()}
    assert abs(scaled[5] - want[5] / ((n - 1) * (n - 2))) < 1e-9


def test_core_numbers_go_beyond_any_limit(spark):
    clique = [(i, j) for i in range(105) for j in range(i)]
    got = {r.node: r.core for r in graph.core_numbers(edges(spark, [*clique, (0, 200), (200, 201)])).collect()}
    assert got == {**dict.fromkeys(range(105), 104), 200: 1, 201: 1}


def test_communities_are_the_cliques_of_a_ring(spark):
    pairs = [(8 * c + i, 8 * c + j) for c in range(6) for i in range(8) for j in range(i)] + [(8 * c, (8 * c + 12) % 48) for c in range(6)]
    got = {r.node: r.community for r in graph.communities(edges(spark, pairs)).collect()}
    assert got == {i: i // 8 * 8 for i in range(48)}


def test_communities_of_a_chain_have_good_modularity(spark):
    pairs = [(i, i + 1) for i in range(30)]
    e = edges(spark, pairs)
    got = graph.communities(e)
    assert graph.modularity(e, got.withColumnRenamed("community", "c")) > 0.6


def test_scores_that_do_not_settle_raise(spark):
    with pytest.raises(DataInsufficient, match="did not settle"):
        graph.pagerank(edges(spark, [(0, 1), (1, 2), (2, 0), (0, 2)]), most=1)
    with pytest.raises(DataInsufficient, match="did not settle"):
        graph.eigenvector_centrality(edges(spark, [(0, 1), (1, 2), (2, 0), (0, 2)]), most=1)


def test_triangles_of_hubs_against_all_triples(spark):
    rng = random.Random(7)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(500)} | {(0, i) for i in range(300)} | {(i, i + 1) for i in range(200, 240)}
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    want = {v: (sum(len(out[w] & out[v]) for w in out[v]) // 2, len(out[v])) for v in out}
    got = {r.node: (r.triangles, r.degree) for r in graph.triangles(edges(spark, [*pairs, *pairs])).collect()}
    assert got == want


def test_two_paths_without_a_closing_edge_are_not_shuffled(spark):
    """Of 45 * 990 two-paths of a bipartite graph none closes: nearly all must go before the look-up."""
    e = edges(spark, [(i, 1000 + j) for i in range(45) for j in range(45)])
    o = e.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    sets = graph._hashed_sets(o)
    words = {r["__v"]: r.words for r in sets.collect()}
    assert words.keys() == set(range(45)) and all(len(w) == 6 and any(w) for w in words.values())
    inside = sets.crossJoin(spark.range(1000, 1045).withColumnRenamed("id", "w")).where(f"({graph.MASK} & words[cast(pmod(xxhash64(w), size(words)) as int)]) = {graph.MASK}")
    assert inside.count() == 45 * 45
    outside = sets.crossJoin(spark.range(5000, 6000).withColumnRenamed("id", "w")).where(f"({graph.MASK} & words[cast(pmod(xxhash64(w), size(words)) as int)]) = {graph.MASK}")
    assert outside.count() < 45 * 150


def test_communities_take_few_jobs_a_round(spark):
    rng = random.Random(3)
    links = [(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.5 if a // 8 == b // 8 else 0.06)]
    tracker = spark.sparkContext.statusTracker()
    e = edges(spark, links).cache()
    before = len(tracker.getJobIdsForGroup())
    got = graph.communities(e).collect()
    assert len(got) == 40 and 2 < len({r.community for r in got}) < 9
    # a table and its sums a round; draws that do not rise are scored together
    assert len(tracker.getJobIdsForGroup()) - before < 230
    e.unpersist()


def test_searches_of_many_sources_leave_no_table_of_pairs(spark):
    r = random.Random(5)
    out = {a: {b for b in (r.randrange(100) for _ in range(4)) if b != a} for a in range(100)}
    want = {}
    for s in out:
        q, want[s, s] = deque([s]), 0
        while q:
            v = q.popleft()
            for w in out[v]:
                if (s, w) not in want:
                    want[s, w] = want[s, v] + 1
                    q.append(w)
    e, nodes = edges(spark, [(a, b) for a in out for b in out[a]]), spark.createDataFrame([(a,) for a in out], "node long")
    before = len(panel._made)
    got = {x.node: x.closeness for x in graph.closeness(e, nodes).collect()}
    left = sum(spark.read.parquet(p).count() for p in panel._made[before:])
    far = {s: [v for (a, b), v in want.items() if a == s and v] for s in out}
    assert got == pytest.approx({s: len(v) / sum(v) * len(v) / 99 for s, v in far.items() if v})
    assert left < len(want) / 3
    assert {(x.source, x.node): x.steps for x in graph.path_lengths(e, nodes).collect()} == want


def test_tasks_of_a_large_graph_stay_bounded(spark, monkeypatch):
    """Pairs are dealt to as many tasks as their number asks for; modularity with weights equals the plain sum."""
    monkeypatch.setattr(core, "HELD", 50)
    pairs = [(i % 61, i * i % 53 + (0 if i % 3 else 61)) for i in range(1500)]
    u = graph.undirected(edges(spark, pairs))
    want = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    assert {(r.src, r.dst) for r in u.collect()} == want and u.count() == len(want)
    assert u.rdd.getNumPartitions() >= len(want) // 50 > 8
    w = {p: float(p[0] % 4 + 1) for p in want}
    k, inside, m = {}, 0.0, sum(w.values())
    for (a, b), v in w.items():
        k[a % 5], inside = k.get(a % 5, 0.0) + v, inside + v * (a % 5 == b % 5)
        k[b % 5] = k.get(b % 5, 0.0) + v
    nodes = spark.range(200).selectExpr("id as node", "id % 5 as c")
    got = graph.modularity(u.withColumn("w", F.col("src") % 4 + 1.0), nodes)
    assert got == pytest.approx(inside / m - sum(v * v for v in k.values()) / (4 * m * m), rel=1e-12)
