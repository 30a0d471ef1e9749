"""The panoptic paradigm."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.errors import InvalidConfig
from pixelyard.operators import panoptic, semantic, slices


@dataclass
class Result:
    stats: DataFrame
    """``image_id, category_id, sum_iou, n_tp, n_fp, n_fn``: adds up over images, ranks and batches"""
    categories: DataFrame
    mode: str

    def per_class(self) -> DataFrame:
        return panoptic.per_class(self.stats)

    def summary(self, groups: DataFrame | None = None) -> DataFrame:
        return panoptic.average(self.per_class(), self.categories, self.mode, groups=groups)

    def to_dict(self, strict: bool = False) -> dict[str, dict[str, float]]:
        """By label; the counts of classes only where ``strict`` is off."""
        keep = ("pq", "sq", "rq") if strict else ("pq", "sq", "rq", "n")
        return {r["label"]: {k: r[k] for k in keep} for r in self.summary().collect()}

    def sliced(self, manifest: DataFrame, images: DataFrame, cross: tuple = ()) -> DataFrame:
        """``axis, value, label, pq, sq, rq, n`` by slice, and ``overall``."""
        parts = slices.with_overall(slices.slices(manifest, images, cross), images)
        key = ["axis", "value"]
        return panoptic.average(panoptic.per_class(slices.fan_out(self.stats, parts), key), self.categories, extra=key)

    def subset(self, image_ids: list[int]) -> Result:
        return Result(self.stats.where(F.col("image_id").isin(image_ids)), self.categories, self.mode)


@dataclass(frozen=True)
class Evaluator:
    """``things`` overrides which categories are things; ``category_ids`` restricts the result to some.

    ``boundary``: the smaller of the segments' and their bands' overlap counts (from runs only).
    """

    threshold: float = 0.5
    mode: str = "corrected"
    category_ids: tuple[int, ...] | None = None
    things: tuple[int, ...] | None = None
    boundary: bool = False
    dilation_ratio: float = 0.02

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1 or self.mode not in ("strict", "corrected"):
            raise InvalidConfig("a threshold within [0, 1] and a known mode are needed")

    def evaluate(self, categories: DataFrame, gt: DataFrame, dt: DataFrame, overlaps: DataFrame, bands: panoptic.Bands | None = None) -> Result:
        """Segments of both sides (see ``operators.panoptic``) and ``overlaps(image_id, gt_id, dt_id, n)``.

        Every ground truth image needs a prediction; predictions of other images are left out.
        """
        if self.boundary and bands is None:
            raise InvalidConfig("boundary quality needs the label maps: use from_runs with image sizes")
        panoptic.validate(gt, categories)
        images = gt.select("image_id").distinct()
        semantic.require_coverage(images, dt.select("image_id").distinct())
        dt = dt.join(images, "image_id", "left_semi")
        panoptic.validate(dt, categories)
        if self.things is not None:
            categories = categories.withColumn("isthing", F.col("category_id").isin(list(self.things)))
        stats = panoptic.attribution(overlaps, gt, dt, self.threshold, self.mode, bands if self.boundary else None)
        if self.category_ids is not None:
            stats = stats.where(F.col("category_id").isin(list(self.category_ids)))
        return Result(stats, categories, self.mode)

    def from_runs(self, categories: DataFrame, gt: DataFrame, dt: DataFrame, gt_runs: DataFrame, dt_runs: DataFrame, sizes: DataFrame | None = None) -> Result:
        """From run rows ``(image_id, start, len, segment_id)`` of both sides; areas come from the runs.

        ``sizes(image_id, height, width)`` is needed for boundary quality.
        """
        area = lambda runs: runs.groupBy("image_id", "segment_id").agg(F.sum("len").alias("area"))
        sized = lambda segments, runs: segments.drop("area").join(area(runs), ["image_id", "segment_id"])
        gt, dt, bands = sized(gt, gt_runs), sized(dt, dt_runs), None
        if self.boundary and sizes is not None:
            (g_runs, g_band), (d_runs, d_band) = (panoptic.bands(runs, segments, sizes, self.dilation_ratio, self.mode) for runs, segments in ((gt_runs, gt), (dt_runs, dt)))
            bands = panoptic.Bands(panoptic.overlaps(g_runs, d_runs), g_band, d_band)
        return self.evaluate(categories, gt, dt, panoptic.overlaps(gt_runs, dt_runs), bands)

    def optimal_lrp(self, *_args) -> None:
        raise NotImplementedError("optimal LRP isn't defined for panoptic results")
