"""Distributed evaluation: each rank writes its images' state and a header; merging unites them.

The state is ``matches`` for instances, counts by image for panoptic results and confusion counts for
semantic ones. A header holds what has to agree, and a checksum of the state that merging recomputes.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelyard.errors import PartialMismatch, PartitionOverlap, RankCollision
from pixelyard.operators.matching import MATCHES
from pixelyard.plans import panoptic, semantic
from pixelyard.plans.instance import Evaluator, Result
from pixelyard.plans.params import Params
from pixelyard.sources.coco import Dataset

VERSION = 2
HEADER = "rank long, version int, paradigm string, kernel string, mode string, params string, dataset string, checksum string"


def params_hash(params: Params) -> str:
    return hashlib.sha256(json.dumps(asdict(params), sort_keys=True).encode()).hexdigest()


def checksum(state: DataFrame) -> str:
    """A hash of a state's rows, whatever their order."""
    line = F.sha2(F.to_json(F.struct(*sorted(state.columns))), 256)
    pieces = [F.coalesce(F.sum(F.conv(F.substring(line, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in range(2)]
    return hashlib.sha256("/".join(map(str, state.agg(F.count("*"), *pieces).first())).encode()).hexdigest()


def _write(state: DataFrame, images: DataFrame, path: str, rank: int, agrees: tuple) -> None:
    spark = state.sparkSession
    state.write.mode("overwrite").parquet(f"{path}/state")
    images.select("image_id").distinct().write.mode("overwrite").parquet(f"{path}/images")
    header = [(rank, VERSION, *agrees, checksum(spark.read.parquet(f"{path}/state")))]
    spark.createDataFrame(header, HEADER).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")  # last: a state without it isn't whole


def _merge(spark: SparkSession, paths: list[str], agrees: tuple, strict: bool) -> DataFrame:
    """The state of all ranks; headers must agree, contents be as written, and images be disjoint."""
    headers = [spark.read.schema(HEADER).parquet(f"{p}/header").first() for p in paths]
    for path, h in zip(paths, headers, strict=True):
        if h is None or tuple(h)[1:-1] != (VERSION, *agrees):
            raise PartialMismatch(f"{path}: not of this dataset and these parameters")
        if h["checksum"] != checksum(spark.read.parquet(f"{path}/state")):
            raise PartialMismatch(f"{path}: its content isn't what was written")
    ranks = [h["rank"] for h in headers]
    if strict and len(set(ranks)) < len(ranks):
        raise RankCollision("two states have the same rank")
    images = None
    for i, p in enumerate(paths):
        part = spark.read.schema("image_id long").parquet(f"{p}/images").withColumn("at", F.lit(i))
        images = part if images is None else images.unionByName(part)
    twice = images.groupBy("image_id").agg(F.array_sort(F.collect_set("at")).alias("at")).where(F.size("at") > 1).first()
    if twice is not None:
        raise PartitionOverlap(f"image {twice['image_id']} is in ranks {[ranks[i] for i in twice['at']]}")
    return spark.read.parquet(*[f"{p}/state" for p in paths])


def write(evaluator: Evaluator, data: Dataset, dt: DataFrame, rank: int, path: str) -> None:
    """One rank's state. ``dt`` holds the rank's images only."""
    result = evaluator.match(data, dt)
    _write(result.matches, dt, path, rank, ("instance", evaluator.kernel.name, result.params.mode, params_hash(result.params), data.digest()))


def merge(spark: SparkSession, evaluator: Evaluator, data: Dataset, paths: list[str]) -> Result:
    """The result of all ranks together; their headers must agree and their images be disjoint."""
    empty = evaluator.match(data, data.gt.select(F.lit(0).cast("long").alias("dt_id"), "image_id", "category_id", F.lit(0.0).alias("score"), "bbox", "area", "ord", *[c for c in ("keypoints", "mask", "tight") if c in data.gt.columns]).where(F.lit(False)))
    empty.matches = _merge(spark, paths, ("instance", evaluator.kernel.name, empty.params.mode, params_hash(empty.params), data.digest()), empty.params.mode == "strict").select(*[f.split()[0] for f in MATCHES.split(", ")])
    return empty


def _hash_of(evaluator) -> str:
    return hashlib.sha256(json.dumps(asdict(evaluator), sort_keys=True, default=sorted).encode()).hexdigest()


def _categories_hash(categories: DataFrame) -> str:
    return checksum(categories.select("category_id", "isthing"))


def write_panoptic(evaluator: panoptic.Evaluator, result: panoptic.Result, rank: int, path: str) -> None:
    """One rank's counts by image and category: sums over them don't depend on how images were dealt to ranks."""
    _write(result.stats, result.stats, path, rank, ("panoptic", "", evaluator.mode, _hash_of(evaluator), _categories_hash(result.categories)))


def merge_panoptic(spark: SparkSession, evaluator: panoptic.Evaluator, categories: DataFrame, paths: list[str]) -> panoptic.Result:
    stats = _merge(spark, paths, ("panoptic", "", evaluator.mode, _hash_of(evaluator), _categories_hash(categories)), evaluator.mode == "strict")
    return panoptic.Result(stats, categories, evaluator.mode)


def write_semantic(evaluator: semantic.Evaluator, result: semantic.Result, rank: int, path: str) -> None:
    """One rank's pixels by image and pair of classes."""
    counts = result.runs.groupBy("image_id", "gt_class", "dt_class").agg(F.sum("n").alias("n"))
    _write(counts, result.runs, path, rank, ("semantic", "", evaluator.mode, _hash_of(evaluator), ""))


def merge_semantic(spark: SparkSession, evaluator: semantic.Evaluator, paths: list[str]) -> semantic.Result:
    return semantic.Result(_merge(spark, paths, ("semantic", "", evaluator.mode, _hash_of(evaluator), ""), evaluator.mode == "strict"), evaluator)
