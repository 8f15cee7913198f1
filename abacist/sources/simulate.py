"""Seeded data generators: every draw is a hash of row keys, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.functions.columns import normal, uniform


def rct(spark: SparkSession, n: int = 1000, effect: float = 1.0, covariates: int = 3, seed: int = 0, of: DataFrame | None = None) -> DataFrame:
    """An effect planted in a randomised trial over the ids of ``of``, or over ``n`` numbered ones."""
    d = (spark.range(n) if of is None else of).select("id", (uniform(seed, F.col("id")) < 0.5).cast("double").alias("treatment"), *[normal(seed + 10 + k, F.col("id")).alias(f"x{k + 1}") for k in range(covariates)])
    return d.withColumn("y", effect * F.col("treatment") + sum((0.5 * F.col(f"x{k + 1}") for k in range(covariates)), F.lit(0.0)) + normal(seed + 1, F.col("id")))


def observational(spark: SparkSession, n: int = 2000, effect: float = 2.0, seed: int = 0, of: DataFrame | None = None) -> DataFrame:
    """Treatment by two covariates, over the ids of ``of`` or ``n`` numbered ones."""
    d = (spark.range(n) if of is None else of).select("id", normal(seed, F.col("id")).alias("x1"), normal(seed + 1, F.col("id")).alias("x2"))
    d = d.withColumn("propensity_score", 1 / (1 + F.exp(-(0.5 * F.col("x1") - 0.25 * F.col("x2")))))
    d = d.withColumn("treatment", (uniform(seed + 2, F.col("id")) < F.col("propensity_score")).cast("double"))
    return d.withColumn("y", effect * F.col("treatment") + F.col("x1") + 0.5 * F.col("x2") + normal(seed + 3, F.col("id")))


def instrument(spark: SparkSession, n: int = 2000, effect: float = 1.0, strength: float = 1.0, seed: int = 0) -> DataFrame:
    d = spark.range(n).select("id", normal(seed, F.col("id")).alias("instrument"), normal(seed + 1, F.col("id")).alias("u"), normal(seed + 2, F.col("id")).alias("x1"))
    d = d.withColumn("treatment", strength * F.col("instrument") + F.col("u") + 0.3 * F.col("x1") + normal(seed + 3, F.col("id")))
    return d.withColumn("y", effect * F.col("treatment") + F.col("u") + 0.5 * F.col("x1") + normal(seed + 4, F.col("id"))).drop("u")


def staggered(spark: SparkSession, units: int = 200, periods: int = 10, effect: float = 1.0, seed: int = 0, of: DataFrame | None = None) -> DataFrame:
    """A third each: treated from a third of the way, from two thirds, never (null); units are the ids of ``of``, or numbered."""
    d = (spark.range(units) if of is None else of).select(F.col("id").alias("unit"), normal(seed, F.col("id")).alias("a"))
    first = F.when(F.col("unit") % 3 == 0, periods // 3 + 1).when(F.col("unit") % 3 == 1, 2 * periods // 3 + 1)
    d = d.withColumn("first_treat", first).withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    on = F.coalesce((F.col("time") >= F.col("first_treat")), F.lit(False)).cast("double")
    return d.withColumn("treated", on).withColumn("y", F.col("a") + 0.2 * F.col("time") + effect * on + 0.5 * normal(seed + 1, F.col("unit"), F.col("time"))).drop("a")


def discontinuity(spark: SparkSession, n: int = 4000, effect: float = 1.0, fuzzy: bool = False, seed: int = 0) -> DataFrame:
    d = spark.range(n).select("id", (2 * uniform(seed, F.col("id")) - 1).alias("x"))
    p = F.when(F.col("x") >= 0, 0.8).otherwise(0.2) if fuzzy else (F.col("x") >= 0).cast("double")
    d = d.withColumn("treatment", (uniform(seed + 1, F.col("id")) < p).cast("double"))
    return d.withColumn("y", effect * F.col("treatment") + F.col("x") + 0.5 * F.col("x") ** 2 + 0.3 * normal(seed + 2, F.col("id")))


def cluster_rct(spark: SparkSession, clusters: int = 40, size: int = 25, effect: float = 0.5, icc: float = 0.1, seed: int = 0) -> DataFrame:
    d = spark.range(clusters * size).select(F.col("id").alias("unit_id"), F.floor(F.col("id") / size).alias("cluster_id"))
    d = d.withColumn("treatment", (F.col("cluster_id") % 2).cast("double"))
    return d.withColumn("y", effect * F.col("treatment") + icc**0.5 * normal(seed, F.col("cluster_id")) + (1 - icc) ** 0.5 * normal(seed + 1, F.col("unit_id")))


def survival(spark: SparkSession, n: int = 1000, hazard_ratio: float = 2.0, seed: int = 0) -> DataFrame:
    d = spark.range(n).select("id", (F.col("id") % 2).cast("double").alias("x"))
    t = -F.log(uniform(seed, F.col("id"))) / (0.1 * F.pow(F.lit(hazard_ratio), F.col("x")))
    c = 20 * uniform(seed + 1, F.col("id"))
    return d.withColumns({"time": F.ceil(F.least(t, c) * 10) / 10, "event": (t <= c).cast("double")})


def panel(spark: SparkSession, units: int = 100, periods: int = 8, effect: float = 0.7, seed: int = 0) -> DataFrame:
    d = spark.range(units * periods).select(F.floor(F.col("id") / periods).alias("unit"), (F.col("id") % periods).alias("time"))
    d = d.withColumn("a", normal(seed, F.col("unit")))
    d = d.withColumn("x", 0.5 * F.col("a") + normal(seed + 1, F.col("unit"), F.col("time")))
    return d.withColumn("y", effect * F.col("x") + F.col("a") + 0.1 * F.col("time") + normal(seed + 2, F.col("unit"), F.col("time"))).drop("a")


def bunched(spark: SparkSession, n: int = 20_000, threshold: float = 100.0, share: float = 0.1, seed: int = 0) -> DataFrame:
    base = 50 + 100 * uniform(seed, F.col("id"))
    near = (base > threshold) & (base < threshold + 10) & (uniform(seed + 1, F.col("id")) < 5 * share)
    return spark.range(n).select("id", F.when(near, threshold + uniform(seed + 2, F.col("id"))).otherwise(base).alias("income"))


def synthetic(spark: SparkSession, units: int = 12, periods: int = 30, start: int = 20, effect: float = 3.0, seed: int = 0) -> DataFrame:
    """Unit 0 is treated from ``start``; its factor loadings lie among the donors'."""
    d = spark.range(units * periods).select(F.floor(F.col("id") / periods).alias("unit"), (F.col("id") % periods).alias("time"))
    load = F.when(F.col("unit") == 0, 1.5).otherwise(1 + uniform(seed, F.col("unit")))
    f = F.sin(F.col("time") / 3) * 2 + F.col("time") * 0.2
    on = ((F.col("unit") == 0) & (F.col("time") >= start)).cast("double")
    return d.withColumn("y", load * f + effect * on + 0.1 * normal(seed + 1, F.col("unit"), F.col("time"))).withColumn("treated", on)
