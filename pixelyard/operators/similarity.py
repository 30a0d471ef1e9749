"""Similarities by kernel, as functions of two sides' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelyard.functions.geometry import COCO_SIGMAS, intersection, oks
from pixelyard.operators.masks import mask_iou
from pixelyard.operators.matching import bbox_similarity
from pixelyard.plans.params import Bbox, Boundary, Keypoints, Segm

Similarity = Callable[[object, object], Column]


def segm(g, d) -> Column:
    """Masks meet only where their tight boxes do."""
    return mask_iou(g["mask"], d["mask"], g["iscrowd"], intersection(g["tight"], d["tight"]) > 0)


def boundary(g, d) -> Column:
    """The smaller of mask and boundary IoU; a crowd has its mask IoU alone."""
    touch = intersection(g["tight"], d["tight"]) > 0
    whole = mask_iou(g["mask"], d["mask"], g["iscrowd"], touch)
    edge = mask_iou(g["band"], d["band"], F.lit(False), touch & ~g["iscrowd"])
    return F.when(g["iscrowd"], whole).otherwise(F.least(whole, edge))


def keypoints(sigmas: dict[int, tuple[float, ...]] | None = None) -> Similarity:
    def score(g, d) -> Column:
        chosen: Column = F.array(*[F.lit(float(s)) for s in COCO_SIGMAS])
        for category, own in (sigmas or {}).items():
            chosen = F.when(g["category_id"] == category, F.array(*[F.lit(float(s)) for s in own])).otherwise(chosen)
        return F.when(g["keypoints"].isNotNull() & d["keypoints"].isNotNull(), oks(g["keypoints"], d["keypoints"], g["bbox"], g["area"], chosen)).otherwise(F.lit(0.0))

    score.anywhere = True  # points may be close where boxes are apart
    return score


def of_kernel(kernel) -> Similarity:
    if isinstance(kernel, Bbox):
        return bbox_similarity
    if isinstance(kernel, Segm):
        return segm
    if isinstance(kernel, Boundary):
        return boundary
    if isinstance(kernel, Keypoints):
        return keypoints(kernel.sigmas)
    return kernel.similarity
