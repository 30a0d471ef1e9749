"""Slice manifests and result documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelyard.errors import InvalidConfig


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """``key`` and a column an axis; numeric axis values are refused."""
    axes = sorted({a for r in rows for a in r if a != "key"})
    if not rows or not axes:
        raise InvalidConfig("a manifest needs keys and axes")
    for r in rows:
        if any(not isinstance(r[a], str) for a in axes if r.get(a) is not None):
            raise InvalidConfig("axis values are text")
    schema = "key long, " + ", ".join(f"`{a}` string" for a in axes)
    out = spark.createDataFrame([(int(r["key"]), *(r.get(a) for a in axes)) for r in rows], schema)
    if out.groupBy("key").count().where("count > 1").take(1):
        raise InvalidConfig("a key stands twice")
    return out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    document = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))
    if document.get("manifest_version") != "1" or document.get("key_kind") not in ("image_id", "result"):
        raise InvalidConfig("not a manifest of version 1")
    return from_rows(spark, document["rows"])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    if "key" not in rows.columns or len(rows.columns) < 2:
        raise InvalidConfig("a manifest needs the column key and an axis")
    axes = [c for c in rows.columns if c != "key"]
    numeric = rows.where(" OR ".join(f"try_cast(`{a}` AS double) IS NOT NULL" for a in axes)).take(1)
    if numeric:
        raise InvalidConfig("axis values are text, not numbers")
    return rows.select(F.col("key").cast("long").alias("key"), *axes)


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``source, metric, value`` of result documents (version 1: ``stats`` by name; version 2: rows)."""
    raw = spark.read.option("wholetext", True).text(paths).select(F.input_file_name().alias("source"), "value")
    v1 = F.from_json("value", "version int, stats map<string,double>")
    v2 = F.from_json("value", "version int, lines array<struct<name:string,value:double>>")
    flat = raw.select("source", F.when(v1["stats"].isNotNull(), F.transform(F.map_entries(v1["stats"]), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))).otherwise(v2["lines"]).alias("lines"))
    return flat.select("source", F.explode("lines").alias("x")).select("source", F.col("x.name").alias("metric"), F.col("x.value").alias("value"))
