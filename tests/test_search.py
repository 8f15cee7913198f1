"""Searches within components: blocks of sources, components too large for a task, and what they cost."""

import random

import pandas as pd
import pytest
from abacist.operators import graph, panel, search
from pyspark.sql import functions as F


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double").repartition(3)


def searched(out, s):
    steps, level = {s: 0}, [s]
    while level:
        level = list({w: 0 for v in level for w in out.get(v, ()) if w not in steps})
        steps |= dict.fromkeys(level, max(steps.values()) + 1)
    return steps


def several(seed=2):
    """Links of some components of 1 to 25 nodes, with ids over 2 ** 53 that stand in no order."""
    rng = random.Random(seed)
    ids = [2**53 + i for i in range(120)]
    rng.shuffle(ids)
    out, at = {}, 0
    for n in (25, 2, 17, 3, 20, 30):
        for i in range(at, at + n):
            out[ids[i]] = {ids[rng.randrange(at, at + n)] for _ in range(2)} | ({ids[i + 1]} if i + 1 < at + n else set())
        at += n
    return out


@pytest.mark.parametrize("block", [1, 100, 10**6])
def test_blocks_of_sources_cover_all_pairs(monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    out = several()
    part = {v: min(searched({a: {b for b in out if a in out[b]} | out[a] for a in out}, v)) for v in out}
    rows = [(part[a], True, a, b) for a in out for b in out[a]] + [(part[a], False, a, a) for a in out if a % 3] + [(7, False, 7, 7)]
    random.Random(1).shuffle(rows)
    rows = pd.DataFrame(rows, columns=["component", "link", "a", "b"])
    want = {(s, v): k for s in [*(a for a in out if a % 3), 7] for v, k in searched(out, s).items()}
    parts = list(search.lengths(rows))
    assert len(parts) > 10 or block > 100
    got = pd.concat(parts)
    assert len(got) == len(want) and dict(zip(zip(got.source, got.node), got.steps)) == want
    got = pd.concat(search.reaches(rows)).set_index("node")
    assert all(tuple(got.loc[s]) == (sum(a == s and k > 0 for (a, _), k in want.items()), sum(k for (a, _), k in want.items() if a == s)) for s, _ in want)


@pytest.mark.parametrize("bound", [0, 60, 10**6])
def test_components_beyond_a_task_are_searched_in_rounds(spark, monkeypatch, bound):
    """None, some and all components in tasks, a component's sources in several chunks: the same rows."""
    monkeypatch.setattr(search, "BOUND", bound)
    monkeypatch.setattr(search, "SHARED", 4)
    monkeypatch.setattr(search, "WORK", 300)
    out = several()
    e = edges(spark, [(a, b) for a in out for b in out[a]])
    nodes = spark.createDataFrame([(a,) for a in [*out, 7]], "node long")
    got = {(r.source, r.node): r.steps for r in graph.path_lengths(e, nodes).collect()}
    want = {(s, v): k for s in [*out, 7] for v, k in searched(out, s).items()}
    assert got == want
    far = {s: [k for (a, _), k in want.items() if a == s and k] for s in out}
    n = len({v for s in out for v in [s, *out[s]]})
    got = {r.node: r.closeness for r in graph.closeness(e, nodes).collect()}
    assert got == pytest.approx({s: len(k) / sum(k) * len(k) / (n - 1) for s, k in far.items() if k})
    got = {r.node: r.betweenness for r in graph.betweenness_centrality(e).collect()}
    assert len(got) == n and sum(got.values()) == pytest.approx(sum(k - 1 for ks in far.values() for k in ks))


def test_searches_along_a_path_take_no_round_a_level(spark):
    """120 levels: neither jobs nor written rows grow with them."""
    e, nodes = edges(spark, [(i, i + 1) for i in range(120)]).cache(), spark.range(121).withColumnRenamed("id", "node")
    tracker = spark.sparkContext.statusTracker()
    for f in (graph.closeness, graph.path_lengths, lambda e, nodes: graph.betweenness_centrality(e)):
        jobs, tables = len(tracker.getJobIdsForGroup()), len(panel._made)
        rows = f(e, nodes).agg(F.count("*")).first()[0]
        assert rows == {graph.closeness: 120, graph.path_lengths: 121 * 122 // 2}.get(f, 121)
        assert len(tracker.getJobIdsForGroup()) - jobs < 150
        assert sum(spark.read.parquet(p).count() for p in panel._made[tables:]) < 30 * 121
    e.unpersist()


@pytest.mark.parametrize("bound", [0, 10**6])
def test_communities_are_cliques_at_either_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(search, "BOUND", bound)
    pairs = [(6 * c + i, 6 * c + j) for c in range(5) for i in range(6) for j in range(i)] + [(6 * c, 6 * c + 7) for c in range(4)]
    got = {r.node: r.community for r in graph.communities(edges(spark, pairs)).collect()}
    assert got == {v: v // 6 * 6 for v in range(30)}


def test_communities_settle_on_a_long_chain_without_rounds(spark):
    """However many nodes: no bound of rounds is met, and no two neighbouring communities gain by merging."""
    m = 3000
    chain = [(i, i + 1) for i in range(m)]
    got = {r.node: r.community for r in graph.communities(edges(spark, chain), rounds=0).collect()}
    assert got.keys() == set(range(m + 1))
    size = {}
    for v, c in got.items():
        size[c] = size.get(c, 0) + 2 - (v in (0, m))
    between = {}
    for a, b in chain:
        if got[a] != got[b]:
            pair = tuple(sorted((got[a], got[b])))
            between[pair] = between.get(pair, 0) + 1
    assert 1 < len(size) < 200 and all(n / m <= size[a] * size[b] / (2 * m * m) + 1e-9 for (a, b), n in between.items())


def test_communities_do_not_depend_on_the_dealing(spark):
    rng = random.Random(6)
    pairs = [(100 * c + rng.randrange(30), 100 * c + rng.randrange(30)) for c in range(8) for _ in range(70)]
    e = edges(spark, pairs)
    got = {r.node: r.community for r in graph.communities(e).collect()}
    rows = pd.DataFrame([(a, b, 1.0) for p in pairs for a, b in (p, p[::-1])], columns=["a", "b", "w"]).groupby(["a", "b"], as_index=False).sum().sample(frac=1, random_state=1)
    one = pd.concat(search.louvain(rows, 2.0 * len(pairs), 1.0))
    assert dict(zip(one.node, one.community)) == got and all(v // 100 == c // 100 for v, c in got.items())
    assert graph.modularity(e, spark.createDataFrame(list(got.items()), "node long, c long")) > 0.8


@pytest.mark.parametrize("ranked", [4, 10**6])
def test_triangles_write_no_pointed_edges(spark, monkeypatch, ranked):
    """Few or all degrees known: the same triangles; edges are written once, without their direction."""
    monkeypatch.setattr(graph, "RANKED", ranked)
    rng = random.Random(8)
    pairs = {(rng.randrange(50), rng.randrange(50)) for _ in range(300)} | {(0, i) for i in range(120)} | {(1, i) for i in range(60, 200)}
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    tables = len(panel._made)
    got = {r.node: (r.triangles, r.degree) for r in graph.triangles(edges(spark, pairs)).collect()}
    assert got == {v: (sum(len(out[w] & out[v]) for w in out[v]) // 2, len(out[v])) for v in out}
    assert sum(spark.read.parquet(p).count() for p in panel._made[tables:]) == sum(map(len, out.values())) // 2 + len(out)


def test_few_two_paths_pass_the_set_by_chance(spark):
    e = edges(spark, [(i, 1000 * i + j) for i in range(45) for j in range(45)]).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    met = graph._hashed_sets(e).crossJoin(spark.range(50_000, 51_000).withColumnRenamed("id", "w"))
    assert met.where(f"({graph.MASK} & words[cast(pmod(xxhash64(w), size(words)) as int)]) = {graph.MASK}").count() < 45 * 32
