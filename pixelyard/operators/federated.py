"""Federated ground truth: each image is labelled for some categories only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.operators import matching
from pixelyard.operators.matching import CELL
from pixelyard.plans.params import Params


def prepare(gt: DataFrame, dt: DataFrame, negatives: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """Ground truth and the ranked detections that are judged.

    Detections are trimmed per image across categories first; those in cells that are neither labelled
    nor known to be empty are left out. In strict mode ground truth without area goes.
    """
    if params.mode == "strict":
        gt = gt.where("area > 0")
    judged = gt.select(*CELL).unionByName(negatives.select(*CELL)).distinct()
    trimmed = matching.top_k(dt, params.max_dets[-1], ["image_id"]).drop("rank")
    kept = trimmed.join(judged, CELL, "left_semi")
    return gt, matching.top_k(kept, params.max_dets[-1])


def match(gt: DataFrame, dt: DataFrame, negatives: DataFrame, not_exhaustive: DataFrame, params: Params, similarity=None) -> tuple[DataFrame, DataFrame]:
    """``matches`` and the ground truth counts; unmatched detections of cells that aren't labelled exhaustively don't count."""
    gt, ranked = prepare(gt, dt, negatives, params)
    return matching.match(gt, ranked, params, similarity, exhaustive=not_exhaustive), matching.ground_truth_counts(gt, params)


def from_images(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bridge tables (negatives, not exhaustive) of image rows with the two id lists."""
    cells = lambda c: images.select("image_id", F.explode(c).alias("category_id")).distinct()
    return cells("neg_category_ids"), cells("not_exhaustive_category_ids")
