"""Readers, writers and payload normalisers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.functions.columns import uniform

FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "parquet": "parquet", "pq": "parquet", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc"}


def read(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A table by the suffix of its path; only the named columns are scanned."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for .{suffix}")
    r = spark.read.schema(schema) if schema else spark.read
    kind = FORMATS[suffix]
    if kind == "csv":
        d = r.csv(path, header=True, sep="\t" if suffix == "tsv" else ",", inferSchema=schema is None)
    elif kind == "json":
        d = r.json(path, multiLine=suffix == "json")
    else:
        d = r.format(kind).load(path)
    return d.select(*columns) if columns else d


def write(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    w = df.write.mode(mode)
    w = w.partitionBy(*partition_by) if partition_by else w
    kind = FORMATS.get(suffix, "parquet")
    (w.option("header", True).option("sep", "\t" if suffix == "tsv" else ",") if kind == "csv" else w).format(kind).save(path)


def sample(df: DataFrame, share: float, keys: list[str], seed: int = 0) -> DataFrame:
    """A fixed share of rows by a hash of keys: the same rows for any partitioning."""
    return df.where(uniform(seed, *[F.col(k) for k in keys]) < share)


def labelled(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Variable labels as column metadata."""
    for name, text in labels.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "label": text})
    return df


def labels_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["label"] for f in df.schema if "label" in f.metadata}


def from_worldbank(spark: SparkSession, payloads: DataFrame, column: str = "value") -> DataFrame:
    """(country, indicator, year, value) from indicator responses, one JSON text ``[header, observations]`` per row."""
    one = F.from_json(F.get_json_object(column, "$[1]"), "array<struct<countryiso3code: string, date: string, value: double, indicator: struct<id: string>>>")
    d = payloads.select(F.explode(one).alias("o"))
    return d.select(F.col("o.countryiso3code").alias("country"), F.col("o.indicator.id").alias("indicator"), F.col("o.date").cast("int").alias("year"), F.col("o.value").alias("value"))


def from_fred(spark: SparkSession, payloads: DataFrame, column: str = "value") -> DataFrame:
    """(date, value) from series observations; a point stands for a missing value."""
    one = F.from_json(F.col(column), "struct<observations: array<struct<date: string, value: string>>>")
    d = payloads.select(F.explode(one["observations"]).alias("o"))
    return d.select(F.to_date("o.date").alias("date"), F.expr("try_cast(o.value as double)").alias("value"))


def from_sdmx(spark: SparkSession, payloads: DataFrame, column: str = "value") -> DataFrame:
    """(series, period, value) from SDMX-JSON data messages: positions in the keys index the dimension values."""
    kind = "struct<dataSets: array<struct<series: map<string, struct<observations: map<string, array<double>>>>>>, structure: struct<dimensions: struct<series: array<struct<values: array<struct<id: string>>>>, observation: array<struct<values: array<struct<id: string>>>>>>>"
    d = payloads.select(F.from_json(F.col(column), kind).alias("m"))
    d = d.select("m.structure.dimensions", F.explode("m.dataSets").alias("ds")).select("dimensions", F.explode("ds.series").alias("key", "s"))
    d = d.select("dimensions", "key", F.explode("s.observations").alias("at", "v"))
    place = F.transform(F.split("key", ":"), lambda k, i: F.get(F.get(F.col("dimensions.series"), i)["values"], k.cast("int"))["id"])
    period = F.get(F.get(F.col("dimensions.observation"), F.lit(0))["values"], F.col("at").cast("int"))["id"]
    return d.select(F.array_join(place, ".").alias("series"), period.alias("period"), F.get("v", F.lit(0)).alias("value"))


def to_json_lines(df: DataFrame) -> list[str]:
    """Rows of a small result as JSON texts."""
    return [json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.collect()]
