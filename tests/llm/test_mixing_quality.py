import re
from collections import Counter, defaultdict

import pytest
from abacist.llm import mixing, quality
from compare import same


def test_op1_sql(spark, small, duck):
    same(mixing.op1_mixing(spark, small), duck.sql(mixing.OP1_SQL))


def test_mix_meets_targets(spark, small):
    rows = mixing.op1_mixing(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    total = sum(r.size for r in rows)
    targets = {s: v[0].target for s, v in by.items()}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by))}
    free = {s: targets[s] / weights[s] for s in by if targets[s] < 2 * by[s][0].source_size - 1e-6}
    assert max(free.values()) == pytest.approx(min(free.values()))
    for s, v in by.items():
        assert abs(sum(r.taken for r in v) - targets[s]) <= max(r.size for r in v)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in v)


def test_positions_invert_the_schedule(spark):
    from pyspark.sql import functions as F

    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    schedules = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 1.0), (0.5, 3.0), (1.0, 0.0)))
    for number, knots in enumerate(schedules):
        got = [r[0] for r in spark.createDataFrame([(x,) for x in shares], "x double").select(mixing.position(F.col("x"), F.lit(number), schedules)).collect()]
        for x, t in zip(shares, got):
            part = mixing.integral([k for k in knots if k[0] <= t] + ([] if t in [k[0] for k in knots] else [(t, next(w0 + (w1 - w0) * (t - t0) / (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:]) if t0 <= t <= t1))]))
            assert part / mixing.integral(knots) == pytest.approx(x, abs=1e-9)


def test_mix_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(odd_docs.repartition(5)).collect()))
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns
    taken, met = Counter(), Counter(r.doc_id for r in out.collect())
    for r in rows:
        taken[r.doc_id] += r.copies
    assert +taken == met


def test_mixing_is_native(spark, small):
    plan = mixing.mix(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [" ".join(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_op5(spark, small, duck, odd_docs, no_docs):
    same(quality.op5_quality(spark, small), duck.sql(quality.OP5_SQL))
    texts = [r.text for r in odd_docs.collect()]
    rows = quality.quality(odd_docs.coalesce(1)).collect()
    assert sorted(tuple(r)[1:6] for r in rows) == sorted(map(brute_quality, texts))
    assert all(not (r.base_failed and r.kept) for r in rows) and quality.quality(no_docs).count() == 0
    assert quality.keep_good(odd_docs).columns == odd_docs.columns


def test_repeats_that_overlap(spark):
    phrase = "a b c d e f g h i j k l"
    texts = [f"{phrase} {phrase}", "x " * 50, f"{phrase} other words between them {phrase} tail", "same " * 7, "a b c d e f g h"]
    rows = quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.n_repeat_words for r in sorted(rows)] == [brute_quality(t)[4] for t in texts]


def test_quality_agrees_with_labels(spark, small):
    rows = quality.op5_quality(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("n_words >= 20").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)
