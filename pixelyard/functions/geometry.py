"""Similarities of boxes and keypoints as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seventeen keypoint sigmas, as tenths.
COCO_SIGMAS = tuple(s / 10.0 for s in (0.26, 0.25, 0.25, 0.35, 0.35, 0.79, 0.79, 0.72, 0.72, 0.62, 0.62, 1.07, 1.07, 0.87, 0.87, 0.89, 0.89))
BOX = "struct<x:double,y:double,w:double,h:double>"


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip("xywh", (x, y, w, h), strict=True)])


def box_from(values: Column, fmt: str = "xywh") -> Column:
    """A box struct of an array of four numbers: ``xywh``, ``xyxy`` or ``cxcywh``."""
    a, b, c, d = (values[i].cast("double") for i in range(4))
    if fmt == "xyxy":
        return box(a, b, c - a, d - b)
    if fmt == "cxcywh":
        return box(a - c / 2, b - d / 2, c, d)
    if fmt != "xywh":
        raise ValueError(f"unknown box format {fmt!r}")
    return box(a, b, c, d)


def box_area(b: Column) -> Column:
    return b["w"] * b["h"]


def intersection(g: Column, d: Column) -> Column:
    """Overlap of two boxes; boxes that only touch have none."""
    w = F.least(g["x"] + g["w"], d["x"] + d["w"]) - F.greatest(g["x"], d["x"])
    h = F.least(g["y"] + g["h"], d["y"] + d["h"]) - F.greatest(g["y"], d["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlapping(g: Column, d: Column) -> Column:
    """Four comparisons that hold just if two boxes have an intersection: cheap enough for every pair of a join."""
    return (g["x"] < d["x"] + d["w"]) & (d["x"] < g["x"] + g["w"]) & (g["y"] < d["y"] + d["h"]) & (d["y"] < g["y"] + g["h"])


def box_iou(g: Column, d: Column, crowd: Column | None = None) -> Column:
    """Intersection over union; over the detection's area alone where the ground truth is a crowd."""
    inter, da = intersection(g, d), box_area(d)
    union = box_area(g) + da - inter
    bottom = union if crowd is None else F.when(crowd, da).otherwise(union)
    return F.when(bottom > 0, inter / bottom).otherwise(F.lit(0.0))


def met_iou(g: Column, d: Column, crowd: Column | None = None) -> Column:
    """``box_iou`` of boxes that are known to overlap: small enough code for the JIT inside a join's condition."""
    w = F.least(g["x"] + g["w"], d["x"] + d["w"]) - F.greatest(g["x"], d["x"])
    h = F.least(g["y"] + g["h"], d["y"] + d["h"]) - F.greatest(g["y"], d["y"])
    inter, da = w * h, box_area(d)
    union = box_area(g) + da - inter
    return inter / (union if crowd is None else F.when(crowd, da).otherwise(union))


def _axis(points: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(points) / 3 - 1).cast("int")), lambda i: F.element_at(points, (3 * i + k + 1).cast("int")))


def oks(gt_points: Column, dt_points: Column, gt_box: Column, gt_area: Column, sigmas: Sequence[float] | Column = COCO_SIGMAS) -> Column:
    """Object keypoint similarity of flat ``[x, y, v] * K`` arrays.

    Over the visible points of the ground truth; with none visible, over all points by their distance
    to the ground truth's box doubled around its centre.
    """
    s = sigmas if isinstance(sigmas, Column) else F.array(*[F.lit(float(x)) for x in sigmas])
    variances = F.transform(s, lambda x: (x * 2) * (x * 2))
    points = F.arrays_zip(_axis(gt_points, 0).alias("gx"), _axis(gt_points, 1).alias("gy"), _axis(gt_points, 2).alias("v"), _axis(dt_points, 0).alias("dx"), _axis(dt_points, 1).alias("dy"), variances.alias("var"))
    seen = F.size(F.filter(points, lambda p: p["v"] > 0)) > 0
    x0, x1 = gt_box["x"] - gt_box["w"], gt_box["x"] + gt_box["w"] * 2
    y0, y1 = gt_box["y"] - gt_box["h"], gt_box["y"] + gt_box["h"] * 2
    zero = F.lit(0.0)

    def error(p: Column) -> Column:
        ex = F.when(seen, p["dx"] - p["gx"]).otherwise(F.greatest(zero, x0 - p["dx"]) + F.greatest(zero, p["dx"] - x1))
        ey = F.when(seen, p["dy"] - p["gy"]).otherwise(F.greatest(zero, y0 - p["dy"]) + F.greatest(zero, p["dy"] - y1))
        return F.exp(-((ex * ex + ey * ey) / p["var"] / (gt_area + F.lit(2.220446049250313e-16)) / 2))

    counted = F.filter(points, lambda p: (p["v"] > 0) | ~seen)
    return F.aggregate(counted, F.lit(0.0), lambda t, p: t + error(p)) / F.size(counted)
