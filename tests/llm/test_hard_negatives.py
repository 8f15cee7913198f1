import math
import random

import pytest
from abacist.llm import hard_negatives as H
from compare import same
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, q string, row int, id int, anchor int, window int, rank int, block int, a int, r int"


def brute(rows, positives, negatives, low=30, high=90, scale=256):
    own = [(k, i, l, [math.floor(scale * x) for x in v]) for k, (i, v, l) in enumerate(rows) if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    place = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    for k, i, l, q in own:
        if i is None or i % 3:
            continue
        scored = [(sum(x * y for x, y in zip(q, p)), j, m, n) for m, j, n, p in own if m != k]
        for p in sorted([s for s in scored if s[3] == l], key=place)[:positives]:
            fit = [s for s in scored if s[3] != l and low * p[0] <= 100 * s[0] <= high * p[0]]
            out += [(i, p[1], rank, s[1], p[0], s[0]) for rank, s in enumerate(sorted(fit, key=place)[:negatives], 1)]
    return sorted(out, key=repr)


def mined(df, **more):
    return sorted((tuple(r) for r in H.mine(df, anchors=F.col("vec_id") % 3 == 0, **more).collect()), key=repr)


def test_query_against_sql(spark, small, duck):
    same(H.op12_hard_negatives(spark, small), duck.sql(H.ORACLE_SQL["op12_hard_negatives"]))


@pytest.mark.parametrize("sizes", [(H.ROWS, H.ANCHORS, H.TILE, H.ROW_BLOCKS), (7, 5, 3, 2)])
def test_against_all_pairs(spark, monkeypatch, sizes):
    """Close vectors, many exact ties and copies, in one block or many small ones."""
    for name, size in zip(("ROWS", "ANCHORS", "TILE", "ROW_BLOCKS"), sizes):
        monkeypatch.setattr(H, name, size)
    rng = random.Random(11)
    centre = [rng.uniform(-1, 1) for _ in range(6)]
    rows = [(i, [c + rng.choice([0, 0, 0.004, -0.3, 0.6]) for c in centre], rng.randrange(3)) for i in range(90)]
    rows += [(100 + i, centre, i % 2) for i in range(20)] + [(200 + i, [rng.uniform(-1, 1) for _ in range(6)], 2) for i in range(30)]
    df = spark.createDataFrame([(*r, *[None] * 9) for r in rows], SCHEMA).repartition(4)
    assert mined(df, positives=2, negatives=4) == brute(rows, 2, 4)
    assert mined(df, positives=3, negatives=1, low=-50, high=60) == brute(rows, 3, 1, -50, 60)


def test_odd_rows(spark):
    """Nulls anywhere, non-finite and missing components, short and empty vectors, repeated ids, a single row, no rows."""
    inf = float("inf")
    rows = [(0, [1.0, 0.5], 1), (3, [0.9, 0.5], 1), (6, None, 1), (9, [1.0, None], 1), (12, [inf, 1.0], 1), (15, [float("nan"), 1.0], 1), (18, [1.0, 1.0], None), (21, [], 1), (24, [0.7], 2), (None, [0.5, 0.5], 2), (27, [0.5, 0.5], 2), (27, [0.5, 0.5], 2), (30, [-1.0, -0.5], 1), (33, [0.0, 0.0], 2), (36, [300.0, 2.0], 2)]
    df = spark.createDataFrame([(*r, *[None] * 9) for r in rows], SCHEMA).coalesce(1)
    assert mined(df) == brute(rows, 5, 10)
    assert mined(df.where("vec_id = 0")) == [] and mined(df.where("false")) == []
    with pytest.raises(ValueError, match="smaller scale"):
        H.mine(df.withColumn("embedding", F.array(F.lit(1e30))), anchors=F.lit(True))


def test_large_components_are_exact(spark):
    """Beyond the integers of doubles the products are taken in 64-bit integers."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(0.2, 1) * 2e5 for _ in range(3)], i % 2) for i in range(40)]
    assert mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == brute(rows, 5, 10)


def test_intervals_drop_most_pairs_early():
    """Once the best are known, the leading planes leave few pairs to look at."""
    import numpy as np

    rng = np.random.default_rng(3)
    a, m = rng.integers(-120, 120, (4, 64)).astype(float), rng.integers(-120, 120, (500, 64))
    m[:40] = a[0] + rng.integers(-3, 3, (40, 64))
    data = b"".join(np.packbits((m + 256 >> j & 1).astype(bool)).tobytes() for j in reversed(range(9)))
    exact = a @ m.T
    floor = np.sort(exact, axis=1)[:, -5:-4].copy()
    far = np.full((4, 1), float(H.FAR))
    x, r, score = H.narrowed(a, data, 500, 9, np.ones((4, 500), bool), -far, far, floor, 5)
    assert (score == exact[x, r]).all() and len(x) < 100
    assert all(set(np.argsort(-exact[i])[:5]) <= set(r[x == i]) for i in range(4))
