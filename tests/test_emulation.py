"""Clones, artificial censoring and weights on tables small enough to work out by hand."""

import math
from functools import reduce
from operator import add

import pytest
from abacist.operators import emulation
from abacist.operators.core import DataInsufficient
from pyspark.sql import functions as F

#: (unit, treated by period, covariate): of z = 1, units 0 and 1 stop after the first period, 2 and 3 go on; of z = 0 unit 4 stops.
UNITS = [(0, [1, 0, 1], 1), (1, [1, 0, 0], 1), (2, [1, 1, 1], 1), (3, [1, 1, 1], 1), (4, [1, 0, 0], 0), (5, [1, 1, 1], 0), (6, [1, 1, 1], 0), (7, [1, 1, 1], 0), (8, [0, 1, 1], 0), (9, [None, 1, 1], 1)]


def clones(spark, **how):
    rows = [(i, t, a, z) for i, path, z in UNITS for t, a in enumerate(path)]
    df = spark.createDataFrame([*rows, (2, None, 1, 1), (10, 0, 1, None)], "id int, t int, a int, z int").repartition(3)
    out = emulation.clone_censor_weight(df, "id", "t", {"always": F.col("a") == 1}, ["z"], **how)
    return {(r.id, r.t): (r.censored, r.weight) for r in out.collect()}


def test_weights_by_interval(spark):
    """Leaving next: 2 of 6 rows with a next one for z = 1, 1 of 7 for z = 0, so staying has chances 2/3 and 6/7; over all 10 of 13."""
    got = clones(spark, stabilise=False)
    want = {(i, 0): (1, 1.0) for i in (0, 1, 4)}
    for i in (2, 3, 5, 6, 7):
        stay = 2 / 3 if i < 4 else 6 / 7
        want |= {(i, k): (0, stay**-k) for k in range(3)}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], rel_tol=1e-6) for k in want)
    both = clones(spark)
    assert all(math.isclose(both[i, k][1], want[i, k][1] * (10 / 13) ** k, rel_tol=1e-6) for i, k in want)


def test_weights_by_pooled_model(spark):
    """Rows of clones that never leave: 6 of 8 for z = 1, 9 of 10 for z = 0, 15 of 18 over all."""
    got = clones(spark, intervals=False)
    assert all(math.isclose(w, 15 / 18 / (6 / 8 if i < 4 else 9 / 10), rel_tol=1e-6) for (i, _), (_, w) in got.items())


def test_nobody_or_everybody_leaves(spark):
    df = spark.createDataFrame([(i, t, 1, i % 2) for i in range(4) for t in range(3)], "id int, t int, a int, z int")
    out = emulation.clone_censor_weight(df, "id", "t", {"always": F.col("a") == 1, "never": F.col("a") == 0}, ["z"])
    assert {(r.strategy, r.censored, r.weight) for r in out.collect()} == {("always", 0, 1.0)}
    assert emulation.clone_censor_weight(df.where("false"), "id", "t", {"always": F.col("a") == 1}, ["z"]).count() == 0
    with pytest.raises(DataInsufficient, match="every row leaves"):
        emulation.clone_censor_weight(df, "id", "t", {"first": F.col("t") == 0}, ["z"])


def test_averages_at_the_bound_itself_are_not_above_it(spark, tmp_path):
    """Six discounts of 0.05 on average, whose doubles add up to more than 0.30 in this order."""
    from abacist.plans import depth, registry  # noqa: F401

    bound = [0.05, 0.03, 0.1, 0.03, 0.07, 0.02]
    assert reduce(add, bound) / 6 > 0.05
    low = {(0, 0), (0, 1), (2, 1)}
    rows = [(i, f"{1995 + y}-01-05 00:00:00", 26.0 - 2 * ((i % 3, y) in low), d) for i in range(12) for y in range(3) for d in (bound if i % 2 else [0.06])]
    df = spark.createDataFrame(rows, "l_suppkey long, l_shipdate string, l_quantity double, l_discount double").coalesce(1)
    df.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["clone_censor_weight"](spark, str(tmp_path)).select("i", "z").distinct().collect()
    assert {(r.i, r.z) for r in got} == {(r.i, 1 - r.i % 2) for r in got} and len(got) > 6
