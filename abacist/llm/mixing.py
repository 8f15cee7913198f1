"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule over training time.  Its integral is the source's weight; the
weights share out the words to train on, no source beyond ``cap`` times its own words.  A source's
documents line up in a fixed pseudo-random order, again and again until its target is met; each
copy's place in that line is a share of the source's demand, and the inverse of the schedule's
running integral turns the share into a training position.  Documents are range-sorted by position.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abacist.llm.common import staged, table, word_count

#: (time, weight) knots, linear between; sources take them in turn. Their integrals are 3, 1 and 2.
SCHEDULES = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))
#: Rows of one source that are put in order within one group, about.
GROUP = 20_000


def integral(knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def _pieces(knots) -> F.Column:
    """Array of (start of the running integral, time, duration, weight at start and end), all scaled to integral 1."""
    total, done, out = integral(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append(F.struct(*[F.lit(float(v)).alias(n) for n, v in (("c", done), ("t", t0), ("d", t1 - t0), ("a", w0 / total), ("b", w1 / total))]))
        done += (t1 - t0) * (w0 + w1) / 2 / total
    return F.array(*out)


def position(share, number, schedules=SCHEDULES) -> F.Column:
    """The time at which a source has met ``share`` of its demand: the inverse of its running integral."""
    knots = F.element_at(F.array(*[_pieces(k) for k in schedules]), F.pmod(number, F.lit(len(schedules))) + 1)
    piece = F.element_at(F.filter(knots, lambda p: p["c"] <= share), -1)
    left, slope = share - piece["c"], (piece["b"] - piece["a"]) / piece["d"]
    root = F.sqrt(F.greatest(F.lit(0.0), piece["a"] * piece["a"] + 2 * slope * left))
    return piece["t"] + F.when(left <= 0, F.lit(0.0)).otherwise(2 * left / (piece["a"] + root))


def targets(sizes: DataFrame, *, schedules=SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: number (by code point, null last), source_size, target.

    ``sizes`` has (source, size).  Words are shared by weight; what a source has above ``cap`` times
    its size is shared again by weight among the others.  In order of cap to weight that comes to a
    water level, found by running sums over the sources.
    """
    weights = F.array(*[F.lit(integral(k)) for k in schedules])
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(weights, F.pmod("number", F.lit(len(schedules))) + 1)).withColumn("most", cap * F.col("source_size"))
    line = Window.orderBy(F.col("most") / F.col("w"), "number")
    before, every = line.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("most") > F.col("level") * F.col("w"), F.struct(F.col("most") / F.col("w"), "number", "level"))).over(every)["level"])
    met = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("w")))
    return s.select("source", "number", "source_size", met.cast("double").alias("target"))


def place(rows: DataFrame, of_source: DataFrame, groups: DataFrame, digits: int, *, passes: int, schedules=SCHEDULES) -> DataFrame:
    """``rows`` (with __id, __source, __size) and their __taken, __target, __source_size and __positions."""
    s = of_source.select(*[F.col(c).alias(f"__{c}" if c != "source" else "__of") for c in of_source.columns])
    keyed = rows.join(s, rows["__source"].eqNullSafe(s["__of"])).drop("__of")
    keyed = keyed.withColumn("__key", _key("__id")).withColumn("__group", F.substring("__key", 1, digits))
    g = groups.select(F.col("number").alias("__number"), F.col("group").alias("__group"), F.col("base").alias("__base"))
    run = Window.partitionBy("__number", "__group").orderBy("__key", F.col("__id").asc_nulls_last(), "__size").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("__base") + F.sum("__size").over(run) - F.col("__size") / 2
    placed = keyed.join(g, ["__number", "__group"]).withColumn("__at", at)
    shares = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: p * F.col("__source_size") + F.col("__at"))
    placed = placed.withColumn("__shares", F.filter(shares, lambda x: (x < F.col("__target")) & (F.col("__size") > 0)))
    placed = placed.withColumn("__positions", F.transform("__shares", lambda x: position(x / F.col("__target"), F.col("__number"), schedules)))
    return placed.withColumn("__taken", F.size("__positions") * F.col("__size"))


def _key(name: str) -> F.Column:
    return F.md5(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def _plan(sizes: DataFrame, **how) -> tuple[DataFrame, DataFrame, int]:
    """Targets, the words of a source before each group of its line, and the digits that name a group."""
    of_source = staged(targets(sizes, **how), "targets")
    digits = max(1, math.ceil(math.log(max(1, sizes.count()) / GROUP + 1, 16)) + 1)
    joined = sizes.join(of_source.select("source", "number").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    sums = joined.groupBy("number", F.substring(_key("id"), 1, digits).alias("group")).agg(F.sum("size").alias("size"))
    run = Window.partitionBy("number").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    return of_source, sums.withColumn("base", F.sum("size").over(run) - F.col("size")), digits


def mix(docs: DataFrame, *, schedules=SCHEDULES, share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies, positions; sorted by first position.

    Size is the number of words; null and empty texts have 0 and are never taken.  A document is
    taken whole, 0 to ``cap`` times; each source's taken words miss its target by half a document
    at most.  Null is a source of its own, the last one.  Rows that repeat an id keep their places
    side by side; the order depends on ids and sizes alone, so reruns agree.  An empty table gives
    an empty result.
    """
    sizes = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    of_source, groups, digits = _plan(sizes, schedules=schedules, share=share, cap=float(cap))
    rows = sizes.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"))
    placed = place(rows, of_source, groups, digits, passes=cap, schedules=schedules)
    out = placed.select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.round("__target", 6).alias("target"), F.col("__taken").alias("taken"), F.size("__positions").alias("copies"), F.col("__positions").alias("positions")
    )
    return out.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), id_col)


def mixed(docs: DataFrame, *, schedules=SCHEDULES, share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as training meets them: each row as often as the mix takes it, range-sorted by position."""
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), word_count(F.col(text_col)).alias("__size"))
    sizes = staged(rows.select(F.col("__id").alias("id"), F.col("__source").alias("source"), F.col("__size").alias("size")), "sizes")
    of_source, groups, digits = _plan(sizes, schedules=schedules, share=share, cap=float(cap))
    placed = place(rows, of_source, groups, digits, passes=cap, schedules=schedules)
    copies = placed.select("__row", "__id", F.explode("__positions").alias("__position"))
    return copies.orderBy("__position", "__id").select("__row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS number FROM s0),
s2 AS (SELECT *, CASE number % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv
       FROM s2 WINDOW b AS (ORDER BY most / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT lv FROM s3 WHERE most > lv * w ORDER BY most / w, number LIMIT 1) AS level FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, level * w) END AS target FROM s4),
p AS (SELECT d.doc_id, d.size, s5.source_size, s5.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2.0::DOUBLE AS pos
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * ((CASE WHEN pos < target THEN 1 ELSE 0 END) + (CASE WHEN source_size + pos < target THEN 1 ELSE 0 END)) AS BIGINT) AS taken
FROM p
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLE_SQL = {"op1_mixing": OP1_SQL}
