"""Result tables: per image, per detection, per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard.errors import OutOfBudget
from pixelyard.plans.params import Params

PAIR_FLOOR, PAIR_CAP = 0.1, 10_000_000


def _bit(c: Column, t: int) -> Column:
    return F.shiftright(c, t).bitwiseAND(F.lit(1))


def per_image(images: DataFrame, gt: DataFrame, matches: DataFrame, params: Params) -> DataFrame:
    """Counts a row of ``images`` at IoU 0.5 and 0.75 over all areas, also for images without boxes."""
    a = params.areas[0]
    n_gt = gt.where(~F.col("ign") & F.col("area").between(a.lo, a.hi)).groupBy("image_id").agg(F.count("*").alias("n_gt"))
    hit, ign = F.col("matched")[0], F.col("ignored")[0]
    t50, t75 = params.iou_index(0.5), params.iou_index(0.75)
    tp = lambda t: _bit(hit.bitwiseAND(F.bitwise_not(ign)), t)
    fp = lambda t: _bit(F.bitwise_not(hit.bitwiseOR(ign)), t)
    full = (1 << len(params.iou_thresholds)) - 1
    every = F.bit_count(hit.bitwiseAND(F.bitwise_not(ign)).bitwiseAND(F.lit(full)))
    found = matches.groupBy("image_id").agg(F.count("*").alias("n_dt"), F.sum(tp(t50)).alias("tp_50"), F.sum(fp(t50)).alias("fp_50"), F.sum(tp(t75)).alias("tp_75"), F.sum(fp(t75)).alias("fp_75"), F.sum(every).alias("tp_all"))
    joined = images.select("image_id").join(n_gt, "image_id", "left").join(found, "image_id", "left").na.fill(0)
    return joined.select("image_id", "n_gt", "n_dt", "tp_50", "fp_50", F.greatest(F.col("n_gt") - F.col("tp_50"), F.lit(0)).alias("fn_50"), "tp_75", "fp_75", F.greatest(F.col("n_gt") - F.col("tp_75"), F.lit(0)).alias("fn_75"), F.floor(F.col("tp_all") / len(params.iou_thresholds)).cast("long").alias("tp_mean"))


def per_detection(matches: DataFrame, pairs: DataFrame, params: Params, boxes: DataFrame | None = None) -> DataFrame:
    """Each detection's fate at IoU 0.5 over all areas, the ground truth it took, and its best overlap in its cell."""
    t = params.iou_index(0.5)
    hit, ign = _bit(F.col("matched")[0], t) == 1, _bit(F.col("ignored")[0], t) == 1
    status = F.when(ign, "ignored").when(hit, "tp").otherwise("fp")
    best = pairs.groupBy("dt_id").agg(F.max("iou").alias("best_iou"))
    rows = matches.select("dt_id", "image_id", "category_id", "score", "area", status.alias("status"), F.get(F.get("gts", F.lit(0)), F.lit(t)).alias("gt_id")).join(best, "dt_id", "left")
    return rows if boxes is None else rows.join(boxes.select("dt_id", "bbox"), "dt_id", "left")


def per_pair(pairs: DataFrame, cap: int = PAIR_CAP) -> DataFrame:
    """The pairs, unless there are more than ``cap``."""
    if pairs.limit(cap + 1).count() > cap:
        raise OutOfBudget(f"more than {cap} pairs; raise the floor")
    return pairs
