"""Nearest neighbours, spatial weights and matching against all pairs."""

import math
import random
import time

import numpy as np
import pytest
from abacist.operators import neighbours
from pyspark.sql import functions as F


def brute(queries, points, k, apart=False, m=None):
    out = []
    for i, q in queries:
        own = sorted((float(np.sum(((np.eye(len(q)) if m is None else m) @ (np.array(q) - np.array(p))) ** 2)), j) for j, p in points if not (apart and j == i))
        out += [(i, r, j, round(math.sqrt(d), 9)) for r, (d, j) in enumerate(own[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    n = len(rows[0][1])
    return spark.createDataFrame([(i, *p) for i, p in rows], "id long, " + ", ".join(f"x{j} double" for j in range(n))).repartition(3)


def got(df):
    return sorted((r.query, r.rank, r.point, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("d, shape", [(1, "even"), (2, "line"), (2, "clumps"), (4, "even")])
def test_against_all_pairs(spark, monkeypatch, d, shape):
    """Small cells, so that blocks must grow: evenly spread, along a slanted line, in clumps with far outliers."""
    monkeypatch.setattr(neighbours, "IN_CELL", 3)
    rng = random.Random(d)
    if shape == "even":
        at = [[rng.uniform(0, 1) for _ in range(d)] for _ in range(160)]
    elif shape == "line":
        at = [[t, 3 * t + rng.gauss(0, 1e-3)] for t in (rng.uniform(-5, 5) for _ in range(160))]
    else:
        at = [[c + rng.gauss(0, 1e-4), 2 * c + rng.gauss(0, 1e-4)] for c in range(8) for _ in range(18)] + [[1e6, -1e6], [-1e7, 5.0]]
    rows = list(enumerate(at))
    cols = [f"x{j}" for j in range(d)]
    assert got(neighbours.nearest(frame(spark, rows), frame(spark, rows), 4, cols, query_id="id", apart=True)) == brute(rows, rows, 4, True)
    asked = [(1000 + i, [rng.uniform(-2, 3) for _ in range(d)]) for i in range(15)]
    assert got(neighbours.nearest(frame(spark, asked), frame(spark, rows), 3, cols, query_id="id")) == brute(asked, rows, 3)


def test_ties_and_odd_rows(spark):
    """Whole-number lattices are full of ties; a third of the points share one place; nulls and too few points."""
    rows = [(i, [float(i % 7), float(i // 7 % 7)]) for i in range(98)] + [(200 + i, [3.0, 3.0]) for i in range(50)]
    f = frame(spark, rows)
    assert got(neighbours.nearest(f, f, 6, ["x0", "x1"], query_id="id", apart=True)) == brute(rows, rows, 6, True)
    null = f.unionByName(spark.createDataFrame([(900, None, 1.0), (None, 1.0, 1.0)], f.schema))
    assert got(neighbours.nearest(null, null, 2, ["x0", "x1"], query_id="id")) == brute(rows, rows, 2)
    few = f.where("id < 3")
    assert got(neighbours.nearest(few, few, 5, ["x0", "x1"], query_id="id", apart=True)) == brute(rows[:3], rows[:3], 5, True)
    assert neighbours.nearest(few, few.where("false"), 5, ["x0", "x1"], query_id="id").count() == 0


def test_weights_and_lag(spark):
    rng = random.Random(8)
    rows = [(i, [rng.random(), rng.random()]) for i in range(60)]
    f = frame(spark, rows)
    near = brute(rows, rows, 5, True)
    w = neighbours.knn_weights(f, ["x0", "x1"], 5, id_col="id")
    assert sorted((r.i, r.j, round(r.w, 9)) for r in w.collect()) == sorted((i, j, 0.2) for i, _, j, _ in near)
    far = {i: d for i, r, _, d in near if r == 5}
    k = {(r.i, r.j): r.w for r in neighbours.kernel_weights(f, ["x0", "x1"], 5, id_col="id").collect()}
    assert len(k) == 360 and all(math.isclose(k[i, j], 1 - d / far[i], abs_tol=1e-7) for i, _, j, d in near) and all(k[i, i] == 1 for i, _ in rows)
    lag = {r.i: r.lag for r in neighbours.spatial_lag(f, w, "x0", "id").collect()}
    x = {i: p[0] for i, p in rows}
    assert all(math.isclose(lag[i], sum(x[j] for a, _, j, _ in near if a == i) / 5) for i, _ in rows)


def test_matching_against_loops(spark):
    """Effect, bias adjustment and error of Mahalanobis matching with replacement."""
    rng = random.Random(1)
    rows = []
    for i in range(120):
        a, b = rng.gauss(0, 1), rng.gauss(0, 3)
        t = int(a + rng.gauss(0, 1.5) > 0.6)
        rows.append((i, t, a, b, 2 * a - b + 1.5 * t + rng.gauss(0, 0.5)))
    df = spark.createDataFrame(rows, "id long, t int, a double, b double, y double").repartition(3)
    X = np.array([r[2:4] for r in rows])
    m = np.linalg.cholesky(np.linalg.inv(np.cov(X.T))).T
    at = {r[0]: list(r[2:4]) for r in rows}
    y = {r[0]: r[4] for r in rows}
    arm = {t: [(r[0], at[r[0]]) for r in rows if r[1] == t] for t in (0, 1)}
    near = brute(arm[1], arm[0], 2, m=m)
    effect = {i: np.mean([y[i] - y[j] for a, _, j, _ in near if a == i]) for i, _ in arm[1]}
    att = np.mean(list(effect.values()))
    twin = {i: j for i, _, j, _ in brute(arm[0], arm[0], 1, True, m)}
    used = {}
    for _, _, j, _ in near:
        used.setdefault(j, []).append(0.5)
    extra = sum((y[j] - y[twin[j]]) ** 2 / 2 * (sum(w) ** 2 - sum(v * v for v in w)) for j, w in used.items())
    var = (sum((e - att) ** 2 for e in effect.values()) + extra) / len(effect) ** 2
    fit, pairs = neighbours.match(df, "y", "t", ["a", "b"], id_col="id", k=2)
    assert math.isclose(fit["att"], att) and math.isclose(fit.stderr("att"), math.sqrt(var)) and pairs.count() == len(near)
    close, _ = neighbours.match(df, "y", "t", ["a", "b"], id_col="id", k=2, caliper=0.3)
    kept = [p for p in near if p[3] <= 0.3]
    assert close.n == len({p[0] for p in kept}) < fit.n
    w = np.array([sum(used[j]) for j in used])
    D = np.column_stack([np.ones(len(used)), [at[j] for j in used]])
    beta = np.linalg.solve(D.T @ (D * w[:, None]), D.T @ (w * [y[j] for j in used]))
    fixed = np.mean([np.mean([y[i] - y[j] - (np.array(at[i]) - at[j]) @ beta[1:] for a, _, j, _ in near if a == i]) for i, _ in arm[1]])
    assert math.isclose(neighbours.match(df, "y", "t", ["a", "b"], id_col="id", k=2, adjust=True)[0]["att"], fixed, rel_tol=1e-9)
    assert abs(fixed - 1.5) < 0.5


def test_scaled_metric_refuses_constant_columns(spark):
    with pytest.raises(ValueError, match="constant"):
        neighbours.metric(spark.range(5).withColumn("c", F.lit(1.0)), ["id", "c"], "scaled")


def test_many_copies_of_a_place_do_not_meet_in_pairs(spark):
    """40,000 points at each of two places: 3.2 thousand million pairs, of which none are made."""
    began = time.perf_counter()
    f = spark.range(80_000).select("id", (F.col("id") % 2).cast("double").alias("x0"), F.lit(0.0).alias("x1")).repartition(5)
    near = neighbours.nearest(f, f, 2, ["x0", "x1"], query_id="id", apart=True).groupBy("query").agg(F.sum("point").alias("s"), F.max("distance").alias("d"), F.count("*").alias("n"))
    # the two smallest other ids of the own place: 0, 2, 4 or 1, 3, 5
    own = F.when(F.col("query") < 2, F.col("query") % 2 * 2 + 6).when(F.col("query") < 4, F.col("query") % 2 * 2 + 4).otherwise(F.col("query") % 2 * 2 + 2)
    assert near.agg(F.count("*"), F.sum((F.col("s") == own).cast("int")), F.max("d"), F.min("n")).first() == (80_000, 80_000, 0.0, 2)
    assert time.perf_counter() - began < 90
