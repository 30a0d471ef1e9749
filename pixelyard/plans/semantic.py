"""The semantic paradigm."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelyard.operators import panoptic, semantic, slices
from pixelyard.sources import png


@dataclass
class Result:
    runs: DataFrame
    evaluator: Evaluator

    def confusion(self) -> DataFrame:
        return semantic.confusion(self.runs, self.evaluator.n_classes, self.evaluator.ignore_label)

    def per_class(self) -> DataFrame:
        return semantic.per_class(self.confusion(), self.evaluator.n_classes, self.evaluator.mode)

    def summary(self, groups: DataFrame | None = None) -> DataFrame:
        classes = self.per_class()
        if self.evaluator.class_ids is not None:
            classes = classes.where(F.col("class_id").isin(list(self.evaluator.class_ids)))
        return semantic.summary(classes, groups=groups)

    def sliced(self, manifest: DataFrame, images: DataFrame, cross: tuple = ()) -> DataFrame:
        """``axis, value`` and the four metrics by slice, and ``overall``."""
        parts = slices.with_overall(slices.slices(manifest, images, cross), images)
        key = ["axis", "value"]
        matrix = semantic.confusion(slices.fan_out(self.runs, parts), self.evaluator.n_classes, self.evaluator.ignore_label, key)
        return semantic.summary(semantic.per_class(matrix, self.evaluator.n_classes, self.evaluator.mode, key), key)


@dataclass(frozen=True)
class Evaluator:
    n_classes: int
    ignore_label: int | None = None
    mode: str = "corrected"
    label_remap: dict[int, int] = field(default_factory=dict)
    class_ids: tuple[int, ...] | None = None

    @staticmethod
    def preset(name: str, **options) -> Evaluator:
        n, ignore = semantic.PRESETS[name]
        return Evaluator(n, ignore, **options)

    def evaluate(self, runs: DataFrame) -> Result:
        """``image_id, gt_class, dt_class, n`` rows of pixels."""
        return Result(semantic.remap(semantic.remap(runs, self.label_remap, "gt_class"), self.label_remap, "dt_class"), self)

    def from_pngs(self, spark: SparkSession, gt_path: str, dt_path: str) -> Result:
        """Label PNGs of both sides that share their file names; a missing prediction is an error."""
        side = lambda path: png.read_runs(spark, path, panoptic=False).withColumn("image_id", F.xxhash64("file_name"))
        gt, dt = side(gt_path), side(dt_path)
        semantic.require_coverage(gt.select("image_id").distinct(), dt.select("image_id").distinct())
        return self.evaluate(panoptic.overlaps(gt, dt).select("image_id", F.col("gt_id").cast("int").alias("gt_class"), F.col("dt_id").cast("int").alias("dt_class"), "n"))
