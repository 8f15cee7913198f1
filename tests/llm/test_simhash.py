import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from abacist.llm import simhash


def brute(rows, k=4, limit=4):
    """(id, fingerprint hex, smallest id reachable) by comparing all pairs."""
    fps = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return fps, grouped([r[0] for r in rows], fps, limit)


def grouped(ids, fps, limit):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= limit):
            x, y = find(i), find(i + 1 + int(j))
            parent[x] = y
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(len(ids))]


def test_query_against_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    fps, comp = brute(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, small).collect()}
    assert got == {r[0]: (f"{f:016x}", c) for r, f, c in zip(rows, fps, comp)}


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    fps, comp = brute(rows)
    got = sorted(map(repr, [tuple(r) for r in simhash.simhash_components(odd_docs).collect()]))
    assert got == sorted(repr((r[0], f"{f:016x}", c)) for r, f, c in zip(rows, fps, comp))
    assert simhash.simhash_components(no_docs).count() == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 40])
def test_links_span_dense_groups(spark, monkeypatch, block):
    """A ball of fingerprints a few bits apart: the components equal those of all pairs, in one task or dealt in blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    centre, far = rng.getrandbits(64), [rng.getrandbits(64) for _ in range(200)]
    ball = list({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for _ in range(150)})
    fps = list(dict.fromkeys(ball + far))
    uniq = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "vid long, f0 long")
    roots = {r.vid: r.root for r in simhash.components(simhash.spanning_links(uniq, 4, 1, simhash.segments(4))).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == grouped(list(range(len(fps))), fps, 4)


def runs_of(sizes, batch):
    """Batches of sorted index rows: run i has key i << 22 and ``sizes[i]`` fingerprints, all within 4 bits of a centre."""
    rng, key, fps = random.Random(5), [], []
    for i, n in enumerate(sizes):
        centre, seen = rng.getrandbits(64), {}
        while len(seen) < n:
            seen[centre ^ sum({1 << rng.randrange(64) for _ in range(4)})] = None
        key += [i << 22] * n
        fps += seen
    t = pa.table({"key": key, "vid": list(range(len(key))), "f0": np.array(fps, dtype=np.uint64).view(np.int64)})
    return t.to_batches(max_chunksize=batch), fps


@pytest.mark.parametrize("batch", [10_000, 3000])
def test_every_group_beyond_the_block_is_handed_on(batch):
    """5000 rows inside one batch, or over several, come out as hot rows, once each; the others as links."""
    batches, fps = runs_of([10, 5000, 3, 100], batch)
    out = pa.Table.from_batches(list(simhash._links(iter(batches), 4, 1, simhash.segments(4), simhash.BLOCK, simhash.SHORT)))
    hot = out.filter(pc.is_valid(out["hot"]))
    assert sorted(hot["a"].to_pylist()) == list(range(10, 5010)) and set(hot["hot"].to_pylist()) == {1 << 22}
    assert dict(zip(hot["a"].to_pylist(), hot["f0"].to_numpy().view(np.uint64).tolist())) == {i: fps[i] for i in range(10, 5010)}
    links = out.filter(pc.is_null(out["hot"]))
    assert not set(range(10, 5010)) & {*links["a"].to_pylist(), *links["b"].to_pylist()}


@pytest.mark.parametrize("bits, limit, n", [(64, 4, 1500), (128, 20, 1500)])
def test_dense_ball_gives_few_links(spark, bits, limit, n):
    """A ball of near copies meets under every key: its links stay linear in its size, and join all that all pairs join."""
    rng = random.Random(bits)
    centre, ball = rng.getrandbits(bits), set()
    while len(ball) < n:
        ball.add(centre ^ sum({1 << rng.randrange(bits) for _ in range(limit // 2)}))
    fps = list(ball)
    width = bits // 64
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, *[signed(f >> 64 * w & (1 << 64) - 1) for w in range(width)]) for i, f in enumerate(fps)]
    uniq = spark.createDataFrame(rows, "vid long, " + ", ".join(f"f{w} long" for w in range(width)))
    for block in (simhash.BLOCK, 400):
        links = simhash.spanning_links(uniq, limit, width, simhash.segments(4), block=block).collect()
        assert block < n or len(links) <= 20 * n
        roots = {r.vid: r.root for r in simhash.components(spark.createDataFrame(links)).collect()}
        cuts, parent = simhash.segments(4), list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        a = np.array([[f >> 64 * w & (1 << 64) - 1 for w in range(width)] for f in fps], dtype=np.uint64)
        for i in range(n):
            x = a[i + 1 :] ^ a[i]
            near = np.flatnonzero((np.bitwise_count(x).sum(1) <= limit) & (simhash._canonical(x, cuts) >= 0)) if len(x) else ()
            for j in near:
                p, q = sorted((find(i), find(i + 1 + int(j))))
                parent[q] = p
        assert [roots.get(i, i) for i in range(n)] == [find(i) for i in range(n)]


def test_workers_get_the_block(spark):
    """Groups of 500 fingerprints under one masked segment, in the middle of a batch, dealt in blocks of 100: components of all pairs."""
    rng = random.Random(11)
    low = rng.getrandbits(32)
    fps = list(dict.fromkeys([low | rng.getrandbits(10) << 40 for _ in range(2000)]))[:500] + [rng.getrandbits(64) for _ in range(100)]
    uniq = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "vid long, f0 long")
    links = simhash.spanning_links(uniq, 1, 1, [(0, 32), (32, 32)], block=200, short=8)
    roots = {r.vid: r.root for r in simhash.components(links).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == grouped(list(range(len(fps))), fps, 1)


def test_components_of_a_path(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.vid: r.root for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_keep_one(spark, small, odd_docs, no_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    ids = sorted(sets)
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    lost = [i for i in ids if i not in kept]
    assert all(any(alike(i, j) for j in ids if j != i) for i in lost)  # clean documents stay
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] & sets[b] and alike(a, b)]
    assert sum(a in kept and b in kept for a, b in links) <= 0.02 * len(links)
    out = simhash.keep_one(odd_docs)
    assert out.columns == odd_docs.columns
    got = [r.doc_id for r in out.collect()]
    assert got.count(7) == 1 and 0 in got and 1 not in got and 2 not in got and None in got and len({3, 4} & set(got)) == 1
    assert simhash.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("how", [{}, {"cap": 1, "block": 20}])
def test_keep_one_verifies_all_candidates_of_a_word_set(spark, how):
    """Texts over the same words in three orders: near-copies of each order are one group, whichever row comes first."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(3):
        rng.shuffle(words)
        for i in range(20):
            copy = words[:]
            copy[6 * i], copy[6 * i + 1] = copy[6 * i + 1], copy[6 * i]
            texts.append(" ".join(copy))
    own = [f"v{i}" for i in range(100)]
    texts += [" ".join([*own[50:], *own[:50][::-1]]), " ".join(own), " ".join([own[1], own[0], *own[2:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs, **how).collect()) == [0, 20, 40, 60, 61]
