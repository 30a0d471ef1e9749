"""Ground truth and results files, with fixed schemas."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelyard.errors import InvalidAnnotation, InvalidDetection
from pixelyard.functions.geometry import box_area, box_from
from pixelyard.operators.masks import mask_of_json, rle_area

IMAGE = "id long, width int, height int, file_name string, neg_category_ids array<long>, not_exhaustive_category_ids array<long>"
CATEGORY = "id long, name string, supercategory string, frequency string, isthing string"
ANNOTATION = "id long, image_id long, category_id long, area double, iscrowd string, ignore string, bbox array<double>, segmentation string, keypoints array<double>, num_keypoints int"
DATASET = f"images array<struct<{IMAGE.replace(' ', ':').replace(',:', ',')}>>, annotations array<struct<{ANNOTATION.replace(' ', ':').replace(',:', ',')}>>, categories array<struct<{CATEGORY.replace(' ', ':').replace(',:', ',')}>>"
DETECTION = "id long, image_id long, category_id long, score double, bbox array<double>, area double, segmentation string, keypoints array<double>, num_keypoints int"


@dataclass
class Dataset:
    """Ground truth as tables."""

    images: DataFrame
    categories: DataFrame
    gt: DataFrame

    @property
    def federated(self) -> bool:
        return bool(self.categories.where(F.col("frequency").isNotNull()).take(1))

    def digest(self) -> str:
        """A hash of the canonical content, whatever the order of rows; a row that stands twice counts twice.

        Four sums over pieces of the rows' hashes and their number are hashed, so each task keeps five numbers.
        """
        line = F.sha2(F.to_json(F.struct("ann_id", "image_id", "category_id", "area", "iscrowd", "ignore", "bbox")), 256)
        piece = lambda i: F.sum(F.conv(F.substring(line, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)"))
        row = self.gt.agg(F.count("*").alias("n"), *[F.coalesce(piece(i), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)]).first()
        return hashlib.sha256("/".join(map(str, row)).encode()).hexdigest()


def _flag(name: str) -> F.Column:
    """0, 1, true and false; absent stays null; anything else is an error."""
    text = F.lower(F.col(name))
    return F.when(text.isNull(), F.lit(None).cast("boolean")).when(text.isin("1", "true", "1.0"), True).when(text.isin("0", "false", "0.0"), False).otherwise(F.raise_error(F.concat(F.lit(f"{name} must be 0 or 1, not "), text)).cast("boolean"))


#: Fixed value: the largest keypoint coordinate.
MOST_POINT = 33_554_432.0


def _points(name: str) -> F.Column:
    """Keypoints must be finite and in range."""
    odd = F.exists(name, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > MOST_POINT))
    return F.when(odd, F.raise_error(F.lit("a keypoint isn't a number within 2 ** 25")).cast("array<double>")).otherwise(F.col(name)).alias(name)


def ground_truth(images: DataFrame, categories: DataFrame, annotations: DataFrame, masks: bool = False) -> Dataset:
    """Typed tables from rows of the three lists; ``annotations`` may have an ``ord``."""
    image = images.select(F.col("id").alias("image_id"), "width", "height", "file_name", *[c for c in ("neg_category_ids", "not_exhaustive_category_ids") if c in images.columns])
    category = categories.select(F.col("id").alias("category_id"), "name", *[c for c in ("supercategory", "frequency", "isthing") if c in categories.columns])
    gt = annotations.select(
        F.col("id").alias("ann_id"),
        "image_id",
        "category_id",
        F.coalesce("area", F.col("bbox")[2] * F.col("bbox")[3]).alias("area"),
        F.coalesce(_flag("iscrowd"), F.lit(False)).alias("iscrowd"),
        _flag("ignore").alias("ignore"),
        box_from(F.col("bbox")).alias("bbox"),
        "segmentation",
        _points("keypoints"),
        "num_keypoints",
        F.col("ord") if "ord" in annotations.columns else F.col("id").alias("ord"),
    )
    gt = with_masks(gt, image) if masks else gt.drop("segmentation")
    return Dataset(image, category, gt)


def with_masks(rows: DataFrame, images: DataFrame, boxes_as_masks: bool = False) -> DataFrame:
    """``mask`` and its tight box ``tight``, decoded once, of rows with a segmentation's JSON text."""
    sized = rows.join(images.select("image_id", "width", "height"), "image_id")
    text = F.col("segmentation")
    if boxes_as_masks:
        b = F.col("bbox")
        corners = F.array(F.array(b["x"], b["y"], b["x"], b["y"] + b["h"], b["x"] + b["w"], b["y"] + b["h"], b["x"] + b["w"], b["y"]))
        text = F.coalesce(text, F.to_json(corners))
    return sized.withColumn("mask", mask_of_json(text, F.col("height"), F.col("width"))).withColumn("tight", F.col("bbox")).drop("segmentation", "width", "height")


def check(data: Dataset) -> Dataset:
    """Raise for the first annotation, in input order, of an unknown image or category."""
    for name, table in (("image_id", data.images), ("category_id", data.categories)):
        bad = data.gt.join(table.select(name), name, "left_anti").orderBy("ord").first()
        if bad is not None:
            raise InvalidAnnotation(f"annotation {bad['ann_id']}: unknown {name} {bad[name]}")
    return data


def read_ground_truth(spark: SparkSession, path: str, masks: bool = False) -> Dataset:
    """A ground truth JSON document. One document is one task: store large ones as Parquet once."""
    doc = spark.read.schema(DATASET).option("multiLine", True).json(path)
    rows = lambda name: doc.select(F.posexplode(name).alias("ord", "x"))
    return ground_truth(rows("images").select("x.*"), rows("categories").select("x.*"), rows("annotations").select("x.*", F.col("ord").cast("long")), masks)


def check_federated(data: Dataset) -> Dataset:
    """Frequencies are r, c or f; no category is both negative and labelled in an image."""
    bad = data.categories.where(~F.coalesce("frequency", F.lit("")).isin("r", "c", "f")).first()
    if bad is not None:
        raise InvalidAnnotation(f"category {bad['category_id']} has no frequency")
    negative = data.images.select("image_id", F.explode("neg_category_ids").alias("category_id"))
    both = negative.join(data.gt.select("image_id", "category_id"), ["image_id", "category_id"], "left_semi").first()
    if both is not None:
        raise InvalidAnnotation(f"image {both['image_id']}: category {both['category_id']} is labelled and negative")
    return data


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_number``, their places from 1 on by ``ord``: counted range by range, not by one task's sort."""
    n = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, "ord").sortWithinPartitions("ord").withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)  # a row's partition and its place there, as Spark lays them out
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    found = dealt.withColumn("_part", part).join(F.broadcast(before), "_part")
    return found.withColumn("_number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def detections(rows: DataFrame, area: str = "from_bbox", images: DataFrame | None = None, masks: bool = False, mode: str = "corrected") -> DataFrame:
    """Typed detections of result rows; ids are 1.. in input order where absent; a NaN score is an error."""
    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.monotonically_increasing_id())
    b, ids = box_from(F.col("bbox")), F.col("id")
    if rows.where(F.col("id").isNull()).take(1):
        rows, ids = _numbered(rows), F.coalesce("id", "_number")
    score = F.when(F.isnan("score") | F.col("score").isNull(), F.raise_error(F.lit("a detection's score isn't a number")).cast("double")).otherwise(F.col("score"))
    out = rows.select(ids.alias("dt_id"), "image_id", "category_id", score.alias("score"), b.alias("bbox"), F.col("area").alias("given"), *[_points(c) if c == "keypoints" else c for c in ("segmentation", "keypoints", "num_keypoints") if c in rows.columns], "ord")
    if masks:
        if mode != "strict" and out.where(F.col("segmentation").isNull()).take(1):
            raise InvalidDetection("a detection has no mask")
        out = with_masks(out, images, boxes_as_masks=mode == "strict")
    elif "segmentation" in out.columns:
        out = out.drop("segmentation")
    box_size = box_area(F.col("bbox"))
    chosen = {"from_bbox": box_size, "supplied": F.coalesce("given", box_size), "mask": rle_area(F.col("mask.counts")).cast("double") if masks else box_size}[area]
    return out.withColumn("area", chosen).drop("given")


def read_detections(spark: SparkSession, path: str, **options) -> DataFrame:
    """A results JSON array, or JSON lines."""
    rows = spark.read.schema(DETECTION).option("multiLine", True).json(path).withColumn("ord", F.monotonically_increasing_id())
    return detections(rows, **options)
