"""Panoptic quality from segment overlaps.

Label maps come as run-length overlaps ``(image_id, gt_id, dt_id, n)`` (id 0 is void) next to the
segment tables; matching needs no order as long as the threshold is at least a half, because then a
segment has at most one partner. Below that, ground truth in ascending id takes its best free partner.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard.errors import InvalidAnnotation
from pixelyard.operators import masks
from pixelyard.workers import ship

VOID = 0
#: What isn't on a segment's band, in a map of bands.
INTERIOR = -1


def overlaps(gt_runs: DataFrame, dt_runs: DataFrame) -> DataFrame:
    """``image_id, gt_id, dt_id, n`` of run rows ``(image_id, start, len, segment_id)`` of both sides.

    Each image's runs of both sides are cut at the union of their starts, in one array pass a side.
    """
    ends = lambda df, name: df.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("len")).alias("stop"), F.col("segment_id").alias("id")))).alias(name))
    both = ends(gt_runs, "g").join(ends(dt_runs, "d"), "image_id")
    ship(gt_runs.sparkSession)

    def run(batches):
        for batch in batches:
            out: dict[tuple, int] = {}
            for image, g, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                i = j = 0
                while i < len(g) and j < len(d):
                    lo, hi = max(g[i]["start"], d[j]["start"]), min(g[i]["stop"], d[j]["stop"])
                    if hi > lo:
                        key = (image, g[i]["id"], d[j]["id"])
                        out[key] = out.get(key, 0) + hi - lo
                    if g[i]["stop"] <= d[j]["stop"]:
                        i += 1
                    else:
                        j += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*((*k, n) for k, n in out.items()), strict=True)], names=["image_id", "gt_id", "dt_id", "n"])

    return both.select("image_id", "g", "d").mapInArrow(run, "image_id long, gt_id long, dt_id long, n long")


def band_map(labels: np.ndarray, order: Sequence[int], d: int, mode: str = "corrected") -> tuple[np.ndarray, dict[int, int]]:
    """A map of the segments' bands, ``d`` pixels deep, and each one's pixels.

    Corrected: bands of the map as it is, by ascending id, a later one over an earlier one; a band's
    pixels are counted before others cover them. Strict: in the given order, each on the map that those
    before it have left.
    """
    out = labels.copy() if mode == "strict" else np.where(labels == VOID, VOID, INTERIOR)
    sizes = {}
    for segment in order if mode == "strict" else sorted(order):
        inside = (out if mode == "strict" else labels) == segment
        band = inside & (masks.erode(inside.astype(np.uint8), d) == 0)
        if mode == "strict":
            out[inside] = INTERIOR
        out[band] = segment
        sizes[segment] = int(band.sum())
    return out, sizes


def bands(runs: DataFrame, segments: DataFrame, sizes: DataFrame, ratio: float = 0.02, mode: str = "corrected") -> tuple[DataFrame, DataFrame]:
    """Runs of every image's map of bands, without interiors, and ``image_id, segment_id, band``, the bands' pixels.

    ``sizes``: ``image_id, height, width``. ``segments`` may have an ``ord``, the order that strict mode paints in.
    """
    ship(runs.sparkSession)
    order = F.array_sort(F.collect_list(F.struct(F.col("ord" if "ord" in segments.columns else "segment_id").alias("o"), "segment_id")))
    own = segments.groupBy("image_id").agg(order.alias("order"))
    maps = runs.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("start", "len", "segment_id"))).alias("runs"))
    rows = maps.join(own, "image_id", "left").join(sizes, "image_id").select("image_id", "height", "width", F.col("runs.start").alias("start"), F.col("runs.len").alias("len"), F.col("runs.segment_id").alias("ids"), F.coalesce(F.col("order.segment_id"), F.array().cast("array<long>")).alias("order"))

    def paint(batches):
        for batch in batches:
            for image, h, w, start, n, ids, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flat = np.zeros(h * w, dtype=np.int64)
                for a, k, x in zip(start, n, ids, strict=True):
                    flat[a : a + k] = x
                painted, found = band_map(flat.reshape(h, w), own, masks.radius(ratio, h, w), mode)
                flat = painted.ravel()
                at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
                sizes = np.diff(np.append(at, flat.size))
                seen = flat[at] != INTERIOR
                columns = [np.append(at[seen], np.full(len(found), -1)), np.append(sizes[seen], list(found.values())), np.append(flat[at][seen], list(found))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), image)), *(pa.array(c.astype(np.int64)) for c in columns)], names=["image_id", "start", "len", "segment_id"])

    out = rows.mapInArrow(paint, "image_id long, start long, len long, segment_id long")
    return out.where("start >= 0"), out.where("start < 0").select("image_id", "segment_id", F.col("len").alias("band"))


def validate(segments: DataFrame, categories: DataFrame) -> None:
    """Segment ids are unique in their image, not void, and of known categories."""
    bad = segments.where(F.col("segment_id") == VOID).first()
    if bad is not None:
        raise InvalidAnnotation(f"image {bad['image_id']}: segment id 0 is void")
    twice = segments.groupBy("image_id", "segment_id").count().where("count > 1").first()
    if twice is not None:
        raise InvalidAnnotation(f"image {twice['image_id']}: segment {twice['segment_id']} stands twice")
    lost = segments.join(categories.select("category_id"), "category_id", "left_anti").first()
    if lost is not None:
        raise InvalidAnnotation(f"segment {lost['segment_id']}: unknown category {lost['category_id']}")


@dataclass
class Bands:
    """What boundary quality needs besides: the overlaps of the maps of bands and the bands' pixels, of both sides."""

    pairs: DataFrame
    gt: DataFrame
    dt: DataFrame


def matched_segments(pairs: DataFrame, gt: DataFrame, dt: DataFrame, threshold: float = 0.5, boundary: Bands | None = None) -> DataFrame:
    """``image_id, gt_id, dt_id, category_id, iou`` of the true positives.

    ``gt`` and ``dt``: ``image_id, segment_id, category_id, area`` (``gt`` also ``iscrowd``). The union leaves
    out the part of the prediction that is void in the ground truth. A partner has the same category,
    isn't a crowd, and overlaps by more than ``threshold``. With ``boundary``, the smaller of the segments'
    and their bands' overlap counts.
    """
    void = pairs.where(F.col("gt_id") == VOID).select("image_id", "dt_id", F.col("n").alias("void"))
    g = gt.where(~F.coalesce("iscrowd", F.lit(False))).select("image_id", F.col("segment_id").alias("gt_id"), F.col("category_id"), F.col("area").alias("g_area"))
    d = dt.select("image_id", F.col("segment_id").alias("dt_id"), F.col("category_id").alias("d_cat"), F.col("area").alias("d_area"))
    rows = pairs.join(g, ["image_id", "gt_id"]).join(d, ["image_id", "dt_id"]).where(F.col("category_id") == F.col("d_cat")).join(void, ["image_id", "dt_id"], "left")
    union = F.col("g_area") + F.col("d_area") - F.col("n") - F.coalesce("void", F.lit(0))
    iou = F.col("n") / union
    if boundary is not None:
        rows = rows.join(boundary.pairs.select("image_id", "gt_id", "dt_id", F.col("n").alias("b_n")), ["image_id", "gt_id", "dt_id"], "left")
        rows = rows.join(boundary.pairs.where(F.col("gt_id") == VOID).select("image_id", "dt_id", F.col("n").alias("b_void")), ["image_id", "dt_id"], "left")
        for side, name in ((boundary.gt, "gt"), (boundary.dt, "dt")):
            rows = rows.join(side.select("image_id", F.col("segment_id").alias(f"{name}_id"), F.col("band").alias(f"{name}_band")), ["image_id", f"{name}_id"], "left")
        b = {c: F.coalesce(c, F.lit(0)) for c in ("b_n", "b_void", "gt_band", "dt_band")}
        b_union = b["gt_band"] + b["dt_band"] - b["b_n"] - b["b_void"]
        iou = F.least(iou, F.when(b_union > 0, b["b_n"] / b_union).otherwise(0.0))
    good = rows.withColumn("iou", iou).where(F.col("iou") > threshold).select("image_id", "gt_id", "dt_id", "category_id", "iou")
    if threshold >= 0.5:
        return good
    ship(pairs.sparkSession)
    cells = good.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("gt_id", (-F.col("iou")).alias("minus"), "dt_id", "category_id"))).alias("x"))

    def run(batches):
        for batch in batches:
            out = []
            for image, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gts, dts = set(), set()
                for r in rows:
                    if r["gt_id"] not in gts and r["dt_id"] not in dts:
                        gts.add(r["gt_id"])
                        dts.add(r["dt_id"])
                        out.append((image, r["gt_id"], r["dt_id"], r["category_id"], -r["minus"]))
            if out:
                types = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["image_id", "gt_id", "dt_id", "category_id", "iou"])

    return cells.mapInArrow(run, "image_id long, gt_id long, dt_id long, category_id long, iou double")


def _counts(sum_iou: Column | None = None, n_tp: int = 0, n_fp: int = 0, n_fn: int = 0) -> list[Column]:
    return [(F.lit(0.0) if sum_iou is None else sum_iou).alias("sum_iou"), *[F.lit(v).cast("long").alias(k) for k, v in (("n_tp", n_tp), ("n_fp", n_fp), ("n_fn", n_fn))]]


def attribution(pairs: DataFrame, gt: DataFrame, dt: DataFrame, threshold: float = 0.5, mode: str = "corrected", boundary: Bands | None = None) -> DataFrame:
    """``image_id, category_id, sum_iou, n_tp, n_fp, n_fn`` per image and category.

    An unmatched prediction of which more than half is void or a crowd of its category isn't a false
    positive. Several crowds of a category count together (strict: only the last by id).
    """
    tp = matched_segments(pairs, gt, dt, threshold, boundary)
    hits = tp.select("image_id", "category_id", *_counts(F.col("iou"), n_tp=1))
    lost = gt.where(~F.coalesce("iscrowd", F.lit(False))).join(tp.select("image_id", F.col("gt_id").alias("segment_id")), ["image_id", "segment_id"], "left_anti").select("image_id", "category_id", *_counts(n_fn=1))
    crowd = gt.where(F.coalesce("iscrowd", F.lit(False))).select("image_id", F.col("segment_id").alias("gt_id"), F.col("category_id").alias("crowd_cat"))
    if mode == "strict":
        crowd = crowd.groupBy("image_id", "crowd_cat").agg(F.max("gt_id").alias("gt_id"))
    free = dt.join(tp.select("image_id", F.col("dt_id").alias("segment_id")), ["image_id", "segment_id"], "left_anti").select("image_id", F.col("segment_id").alias("dt_id"), "category_id", "area")
    covered = pairs.join(free, ["image_id", "dt_id"]).join(crowd, ["image_id", "gt_id"], "left").where((F.col("gt_id") == VOID) | (F.col("crowd_cat") == F.col("category_id"))).groupBy("image_id", "dt_id").agg(F.sum("n").alias("covered"))
    false = free.join(covered, ["image_id", "dt_id"], "left").where(2 * F.coalesce("covered", F.lit(0)) <= F.col("area")).select("image_id", "category_id", *_counts(n_fp=1))
    return hits.unionByName(lost).unionByName(false).groupBy("image_id", "category_id").agg(F.sum("sum_iou").alias("sum_iou"), F.sum("n_tp").alias("n_tp"), F.sum("n_fp").alias("n_fp"), F.sum("n_fn").alias("n_fn"))


def per_class(stats: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``category_id, pq, sq, rq, n_tp, n_fp, n_fn`` from per-image counts."""
    extra = extra or []
    sums = stats.groupBy(*extra, "category_id").agg(F.sum("sum_iou").alias("sum_iou"), F.sum("n_tp").alias("n_tp"), F.sum("n_fp").alias("n_fp"), F.sum("n_fn").alias("n_fn"))
    bottom = F.col("n_tp") + 0.5 * (F.col("n_fp") + F.col("n_fn"))
    value = lambda x: F.when(bottom > 0, x / bottom)
    return sums.select(*extra, "category_id", value(F.col("sum_iou")).alias("pq"), F.when(bottom > 0, F.when(F.col("n_tp") > 0, F.col("sum_iou") / F.col("n_tp")).otherwise(0.0)).alias("sq"), value(F.col("n_tp")).alias("rq"), "n_tp", "n_fp", "n_fn")


def average(classes: DataFrame, categories: DataFrame, mode: str = "corrected", extra: list[str] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """``label, pq, sq, rq, n``: unweighted means over the classes present, for all, things and stuff, or by ``groups(label, category_id)``.

    An empty set is 0, in strict mode an error.
    """
    extra = extra or []
    if groups is not None:
        rows = classes.join(groups, "category_id")
        labels = [r["label"] for r in groups.select("label").distinct().collect()]
    else:
        kinds = F.array(F.lit("all"), F.when(F.col("isthing"), "things").otherwise("stuff"))
        rows = classes.join(categories.select("category_id", "isthing"), "category_id").withColumn("label", F.explode(kinds))
        labels = ["all", "things", "stuff"]
    means = rows.where("pq is not null").groupBy(*extra, "label").agg(*[F.avg(c).alias(c) for c in ("pq", "sq", "rq")], F.count("*").alias("n"))
    if extra:
        return means
    every = classes.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    out = every.join(means, "label", "left").na.fill(0.0, ["pq", "sq", "rq"]).na.fill(0, ["n"])
    if mode == "strict" and out.where("n = 0").first() is not None:
        raise InvalidAnnotation("no class is present")
    return out
