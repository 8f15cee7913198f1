"""Searches and communities within components of a graph: these are dealt to tasks, and a task holds some in numpy arrays.

A component of up to ``BOUND`` links goes to tasks whole, as often as its sources are cut into chunks; what its pairs of
nodes need lives in a task for one block of sources at a time and is never written or shuffled.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.operators.panel import written

#: Links of a component that a task may hold; larger ones are searched in rounds over tables.
BOUND = 4_000_000
#: Sources times links of a component, summed over those of a task.
WORK = 25_000_000
#: Links of a bin where components move as a whole.
LINKS = 100_000
#: Sources of a component that share one copy of its links, at least.
SHARED = 512
#: Nodes and links times sources that are searched together.
BLOCK = 3_000_000


def dealt(edges: DataFrame, part: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(rows of small components, edges and sources of large ones or None).

    ``edges`` (src, dst, further columns) and ``part`` (node, component) are written tables; without ``sources`` (node) a
    component is one piece of work.  Rows are (bin, component, link, a, b, further columns): a link, or a source where
    ``link`` is false and ``a`` and ``b`` are the same.  The rows of a bin stand together in a partition.
    """
    spark, extra = edges.sparkSession, [c for c in edges.columns if c not in ("src", "dst")]
    e = edges.join(part.withColumnRenamed("node", "src"), "src")
    size = e.groupBy("component").agg(F.count("*").alias("links"))
    if sources is not None:
        own = sources.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
        size = own.groupBy("component").agg(F.count("*").alias("from")).join(size, "component", "left").fillna(0, ["links"])
        chunk = F.greatest(F.lit(SHARED), F.floor(F.lit(WORK) / F.greatest("links", F.lit(1))))
        size = size.withColumns({"chunks": F.ceil(F.col("from") / chunk).cast("int"), "work": F.col("from") * F.col("links")})
    else:
        size = size.withColumns({"chunks": F.lit(1), "work": F.col("links")})
    size = written(size, spark)
    small = size.where(F.col("links") <= BOUND)
    work, above = size.agg(F.sum(F.when(F.col("links") <= BOUND, F.col("work"))), F.max("links")).first()
    bins = max(spark.sparkContext.defaultParallelism, -(-(work or 0) // (WORK if sources is not None else LINKS)))
    place = lambda c: F.pmod(F.xxhash64("component", c), F.lit(bins)).alias("bin")
    chunked = e.join(small.select("component", "chunks"), "component").withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = chunked.select(place(F.col("__c")), "component", F.lit(True).alias("link"), F.col("src").alias("a"), F.col("dst").alias("b"), *extra)
    if sources is not None:
        start = own.join(small.select("component", "chunks"), "component").withColumn("__c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        rows = rows.union(start.select(place(F.col("__c")), "component", F.lit(False), F.col("node"), F.col("node")))
    rows = rows.repartition(bins, "bin").sortWithinPartitions("bin")
    if above is None or above <= BOUND:
        return rows, None, None
    large = size.where(F.col("links") > BOUND).select("component")
    return rows, e.join(large, "component").select(*edges.columns), None if sources is None else own.join(large, "component").select("node")


def by_bin(rows: DataFrame, f: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``f`` of each bin's rows, one bin of a partition in memory at a time."""

    def walk(frames):
        held: list[pd.DataFrame] = []
        for frame in frames:
            at = frame["bin"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and hi > lo and held[-1]["bin"].iloc[-1] != at[lo]:
                    yield from f(pd.concat(held))
                    held = []
                if hi > lo:
                    held.append(frame.iloc[lo:hi])
        if held:
            yield from f(pd.concat(held))

    return rows.mapInPandas(walk, schema)


def csr(tails: np.ndarray, heads: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each node's links begin, their heads, the order of the links)."""
    order = np.argsort(tails, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(tails, minlength=n))]), heads[order], order


class Block:
    """Places of some sources: one for each node of a source's component, source by source."""

    def __init__(self, begin: np.ndarray, heads: np.ndarray, start: np.ndarray, low: np.ndarray, size: np.ndarray):
        self.begin, self.heads, self.start, self.size = begin, heads, start, size
        self.first = np.cumsum(size) - size
        self.base = self.first - low  # a source's place of a node is its base plus the node
        self.total = int(size.sum())

    def nodes(self) -> np.ndarray:
        """The node of each place."""
        return np.arange(self.total) - np.repeat(self.base, self.size)

    def search(self, keep: bool = False) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(steps from the source or -1 by place, with ``keep`` the links on shortest paths by level as pairs of places)."""
        steps, mark, links, k = np.full(self.total, -1, dtype=np.int32), np.empty(self.total, dtype=np.int32), [], 0
        node, base = self.start, self.base
        steps[base + node] = 0
        while len(node):
            k += 1
            low = self.begin[node]
            many = self.begin[node + 1] - low
            i = np.repeat(np.arange(len(node)), many)
            head = self.heads[np.arange(len(i)) + (low - (np.cumsum(many) - many))[i]]
            place = base[i] + head
            new = np.flatnonzero(steps[place] < 0)
            i, head, place = i[new], head[new], place[new]
            if keep and len(place):
                links.append(((base + node)[i], place))
            steps[place] = k
            # a place that several links reach goes on once
            mark[place] = np.arange(len(place))
            once = mark[place] == np.arange(len(place))
            node, base = head[once], base[i[once]]
        return steps, links


def blocks(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, Block]]:
    """(ids of the bin's nodes, a block of its sources), over all its sources."""
    link, code, a, b = rows["link"].to_numpy(), pd.factorize(rows["component"])[0], rows["a"].to_numpy(), rows["b"].to_numpy()
    ids, at = np.unique(np.concatenate([a[link], b[link], a[~link]]), return_inverse=True)
    where = np.empty(len(ids), dtype=np.int64)
    where[at] = np.concatenate([code[link], code[link], code[~link]])
    # nodes of a component stand together
    order = np.argsort(where, kind="stable")
    new = np.empty_like(order)
    new[order] = np.arange(len(ids))
    ids, at = ids[order], new[at]
    m = int(link.sum())
    begin, to, _ = csr(at[:m], at[m : 2 * m], len(ids))
    size, links = np.bincount(where, minlength=code.max() + 1), np.bincount(code[link], minlength=code.max() + 1)
    low = np.cumsum(size) - size
    start, own = at[2 * m :], code[~link]
    by = np.argsort(own, kind="stable")
    start, own = start[by], own[by]
    cut = np.cumsum((size + links)[own]) // BLOCK
    ends = [*(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(own)]
    for lo, hi in zip([0, *ends], ends):
        if hi > lo:
            yield ids, Block(begin, to, start[lo:hi], low[own[lo:hi]], size[own[lo:hi]])


def lengths(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """(source, node, steps) of all pairs with a path."""
    for ids, b in blocks(rows):
        steps, _ = b.search()
        met = np.flatnonzero(steps >= 0)
        yield pd.DataFrame({"source": ids[np.repeat(b.start, b.size)[met]], "node": ids[b.nodes()[met]], "steps": steps[met]})


def reaches(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """(node, r, s): how many other nodes each source reaches, and its steps to them in all."""
    for ids, b in blocks(rows):
        steps = b.search()[0].astype(np.int64)
        r = np.add.reduceat((steps > 0).astype(np.int64), b.first)
        yield pd.DataFrame({"node": ids[b.start], "r": r, "s": np.add.reduceat(np.maximum(steps, 0), b.first)})


def shares(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """(node, share): sums over the sources of the share of their shortest paths that pass through the node."""
    total, ids = None, None
    for ids, b in blocks(rows):
        _, links = b.search(keep=True)
        paths, passing = np.zeros(b.total), np.zeros(b.total)
        paths[b.base + b.start] = 1.0
        for a, z in links:
            np.add.at(paths, z, paths[a])
        for a, z in reversed(links):
            np.add.at(passing, a, paths[a] / paths[z] * (1 + passing[z]))
        passing[b.base + b.start] = 0.0
        got = np.bincount(b.nodes(), weights=passing, minlength=len(ids))
        total = got if total is None else total + got
    if total is not None:
        yield pd.DataFrame({"node": ids, "share": total})


def _settled(begin: np.ndarray, heads: np.ndarray, w: np.ndarray, k: np.ndarray, total: float, resolution: float) -> tuple[list[int], bool]:
    """(community of each node, whether any moved): each node in turn goes where modularity gains most, until none gains."""
    n = len(k)
    at, size, k = list(range(n)), k.tolist(), k.tolist()
    least, moved = 1e-12 * total, False
    queue, waits, quiet = deque(range(n)), bytearray(b"\1") * n, True
    while queue:
        v = queue.popleft()
        waits[v] = 0
        lo, hi = begin[v], begin[v + 1]
        near, to, own, kv = heads[lo:hi].tolist(), {}, at[v], k[v]
        for u, x in zip(near, w[lo:hi].tolist()):
            if u != v:
                to[at[u]] = to.get(at[u], 0.0) + x
        size[own] -= kv
        scale = resolution * kv / total
        stay = to.get(own, 0.0) - scale * size[own]
        gain, best = max(((x - scale * size[c], -c) for c, x in to.items()), default=(stay, -own))
        if gain > stay + least:
            at[v], moved, quiet = -best, True, False
            for u in near:
                if not waits[u] and at[u] != -best:
                    waits[u] = 1
                    queue.append(u)
        size[at[v]] += kv
        if not queue and not quiet:
            # sizes changed for all: settled only when a whole turn moves nobody
            queue, waits, quiet = deque(range(n)), bytearray(b"\1") * n, True
    return at, moved


def louvain(rows: pd.DataFrame, total: float, resolution: float) -> Iterator[pd.DataFrame]:
    """(node, community) of links listed in both directions with weights ``w``; nodes stand in the order of their ids, whatever the bin."""
    m = len(rows)
    ids, at = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
    a, b, w, name = at[:m], at[m:], rows["w"].to_numpy(dtype=float), np.arange(len(ids))
    n = len(ids)
    while True:
        begin, heads, order = csr(a, b, n)
        to, moved = _settled(begin, heads, w[order], np.bincount(a, weights=w, minlength=n), total, resolution)
        if not moved:
            break
        first = np.full(n, n)
        np.minimum.at(first, to, np.arange(n))
        left, to = np.unique(first[to], return_inverse=True)
        name, n = to[name], len(left)
        pair, at = np.unique(to[a] * n + to[b], return_inverse=True)
        a, b, w = pair // n, pair % n, np.bincount(at, weights=w)
    first = np.full(n, len(ids))
    np.minimum.at(first, name, np.arange(len(ids)))
    yield pd.DataFrame({"node": ids, "community": ids[first[name]]})
