"""Particle filter: equal to the linear filter where that is exact, and the same on a stream as on a table."""

import numpy as np
import pytest
from abacist.streaming import folds, particles
from pyspark.sql import functions as F


def estimates(spark):
    rng = np.random.default_rng(0)
    rows = [(k, i, float(rng.normal(0.5 * (k or 1), 0.4)), 0.4) for k in (1, 2, None) for i in range(12)]
    return spark.createDataFrame([*rows, (2, 50, None, 0.4), (2, 51, 1.0, 0.0)], "k int, i int, e double, s double").repartition(4)


def test_close_to_the_linear_filter(spark):
    d = estimates(spark)
    got = {(r.k, r.i): r for r in particles.particle_batch(d, "k", "i", "e", "s", particles=20_000, seed=3).collect()}
    assert len(got) == d.count()
    for r in folds.kalman_batch(d.where("i < 50"), "k", "i", "e", "s").collect():
        p = got[r.k, r.i]
        assert p.mean == pytest.approx(r.mean, abs=0.03) and p.variance == pytest.approx(r.variance, rel=0.12)
        assert p.high - p.low == pytest.approx(2 * 1.96 * r.variance**0.5, rel=0.12) and 0 < p.effective <= 20_000.001
    # rows without news leave mean and spread as they were
    assert got[2, 51].mean == pytest.approx(got[2, 11].mean, abs=0.02) and got[2, 50].variance == pytest.approx(got[2, 11].variance, rel=0.1)


def test_moving_state_and_other_densities(spark):
    d = estimates(spark).where("k = 1")
    one = particles.particle_batch(d, "k", "i", "e", "s", particles=500, process_sd=0.3).orderBy("i").collect()
    assert one[-1].variance > 0.02  # a moving state is never known well
    flat = particles.particle_batch(d, "k", "i", "e", "s", particles=500, transition=lambda x, r: x * 0, log_density=lambda e, x, s: np.zeros(len(x))).collect()
    assert all(r.mean == 0 and r.variance == 0 and r.effective == pytest.approx(500) for r in flat)
    with pytest.raises(ValueError, match="100 particles"):
        particles.particle_batch(d, "k", "i", "e", "s", particles=10)
    assert particles.particle_batch(d.where("k > 5"), "k", "i", "e", "s").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    d = estimates(spark).where("i < 50")
    for part, cut in enumerate(("i < 5", "i between 5 and 8", "i > 8")):
        d.where(cut).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = particles.particle_stream(stream, "k", "i", "e", "s", particles=300, process_sd=0.1, threshold=0.9).writeStream.format("memory").queryName("particles").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.k, r.i): r for r in spark.table("particles").collect()}
    want = particles.particle_batch(d, "k", "i", "e", "s", particles=300, process_sd=0.1, threshold=0.9).collect()
    assert len(got) == len(want) == 36
    for r in want:
        assert got[r.k, r.i][2:] == pytest.approx(r[2:])


@pytest.mark.parametrize("how", [{"process_sd": 0.5}, {"threshold": 1.0}, {"transition": lambda x, r: x * 0.9 + r.normal(0, 1, len(x)), "log_density": lambda e, x, s: -abs(e - x) / s}])
def test_keys_move_together_and_tasks_are_cut_by_rows(spark, monkeypatch, how):
    """Rows are those of one step after another, to the last bit, over batches that cut a key and keys of any length."""
    monkeypatch.setattr(particles, "ROWS", 50)
    monkeypatch.setattr(particles, "TOGETHER", 600)
    rng = np.random.default_rng(4)
    rows = [(k, i, None if i % 7 == 3 else float(rng.normal(20 * (k % 2), 4)), 0.0 if i % 11 == 5 else 2.0) for k in range(25) for i in range(3 + 2 * k)] + [(None, i, 1.0, 1.0) for i in range(30)]
    d = spark.createDataFrame(rows, "k int, i int, e double, s double").repartition(3)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        out = particles.particle_batch(d, "k", "i", "e", "s", particles=100, **how)
        got = {(r.k, r.i): tuple(r[2:]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert out.rdd.getNumPartitions() >= len(rows) // 50 > 8
    f, want = particles.Filter(particles=100, **how), {}
    for k in {r[0] for r in rows}:
        state = f.start(k)
        for _, i, e, s in sorted(r for r in rows if r[0] == k):
            state, want[k, i] = f.step(k, state, e, s)
    assert got == want
