"""Registered queries: each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``f(tables)``; doubles of the result are rounded to ``digits`` places."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(f(Tables(spark, sf_dir)), digits)

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def tidy(df: DataFrame, digits: int) -> DataFrame:
    # adding 0.0 turns a negative zero into a plain one
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def one(spark: SparkSession, values: dict) -> DataFrame:
    """A single row of doubles."""
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in values.values())], ", ".join(f"`{k}` double" for k in values))
