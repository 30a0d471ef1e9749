"""Semantic segmentation: confusion counts and the metrics that follow from them.

Pixels come as runs ``(image_id, gt_class, dt_class, n)``: a label map or any run-length form of it
gives such rows, and everything is grouped sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.errors import UnknownImage

#: Presets: classes and the label that is left out.
PRESETS = {"cityscapes": (19, 255), "ade20k": (150, 0), "pascal_voc": (21, 255)}


def require_coverage(gt_images: DataFrame, dt_images: DataFrame) -> None:
    """Every ground truth image needs a prediction; further predictions are left out by the caller's join."""
    lost = gt_images.select("image_id").join(dt_images.select("image_id"), "image_id", "left_anti").first()
    if lost is not None:
        raise UnknownImage(f"no prediction for image {lost['image_id']}")


def remap(runs: DataFrame, mapping: dict[int, int], column: str) -> DataFrame:
    """Classes of ``column`` renamed before counting."""
    if not mapping:
        return runs
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return runs.withColumn(column, F.coalesce(pairs[F.col(column)], F.col(column)))


def confusion(runs: DataFrame, n_classes: int, ignore_label: int | None = None, extra: list[str] | None = None) -> DataFrame:
    """``gt_class, dt_class, n``: pixels by class pair.

    Pixels of the ignored ground truth label go, and so do predictions outside the classes.
    """
    rows = runs if ignore_label is None else runs.where(F.col("gt_class") != ignore_label)
    rows = rows.where(F.col("gt_class").between(0, n_classes - 1) & F.col("dt_class").between(0, n_classes - 1))
    return rows.groupBy(*(extra or []), "gt_class", "dt_class").agg(F.sum("n").cast("long").alias("n"))


def per_class(matrix: DataFrame, n_classes: int, mode: str = "corrected", extra: list[str] | None = None) -> DataFrame:
    """``class_id, n_gt, n_dt, n_hit, iou, recall, precision``; a class without pixels has 0 (strict: NaN)."""
    extra = extra or []
    sides = F.array(F.struct(F.col("gt_class").alias("class_id"), F.col("n").alias("gt"), F.lit(0).cast("long").alias("dt"), F.when(F.col("gt_class") == F.col("dt_class"), F.col("n")).otherwise(0).cast("long").alias("hit")), F.struct(F.col("dt_class").alias("class_id"), F.lit(0).cast("long").alias("gt"), F.col("n").alias("dt"), F.lit(0).cast("long").alias("hit")))
    sums = matrix.select(*extra, F.explode(sides).alias("x")).groupBy(*extra, F.col("x.class_id").alias("class_id")).agg(F.sum("x.gt").alias("n_gt"), F.sum("x.dt").alias("n_dt"), F.sum("x.hit").alias("n_hit"))
    if not extra:
        sums = matrix.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class_id")).join(sums.withColumn("class_id", F.col("class_id").cast("int")), "class_id", "left").na.fill(0)
    empty = F.lit(float("nan") if mode == "strict" else 0.0)
    share = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(empty)
    union = F.col("n_gt") + F.col("n_dt") - F.col("n_hit")
    return sums.select(*extra, "class_id", "n_gt", "n_dt", "n_hit", share(F.col("n_hit"), union).alias("iou"), share(F.col("n_hit"), F.col("n_gt")).alias("recall"), share(F.col("n_hit"), F.col("n_dt")).alias("precision"))


def summary(classes: DataFrame, extra: list[str] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """``miou, fwiou, pixel_accuracy, mean_accuracy``; classes without support stay out of the means.

    ``groups(label, class_id)`` gives a row a group of classes instead of one over all.
    """
    extra = list(extra or [])
    if groups is not None:
        classes = classes.join(groups, "class_id")
        extra.append("label")
    seen = (F.col("n_gt") + F.col("n_dt")) > 0
    total = F.sum("n_gt")
    return classes.groupBy(*extra).agg(
        F.avg(F.when(seen, F.col("iou"))).alias("miou"),
        (F.sum(F.when(F.col("n_gt") > 0, F.col("n_gt") * F.col("iou")).otherwise(0.0)) / total).alias("fwiou"),
        (F.sum("n_hit") / total).alias("pixel_accuracy"),
        F.avg(F.when(F.col("n_gt") > 0, F.col("recall"))).alias("mean_accuracy"),
    )


def merge(*matrices: DataFrame) -> DataFrame:
    """The sum of confusion counts."""
    out = matrices[0]
    for m in matrices[1:]:
        out = out.unionByName(m)
    return out.groupBy("gt_class", "dt_class").agg(F.sum("n").cast("long").alias("n"))


def from_binary_masks(pixels: DataFrame, how: str = "argmax", unlabelled: int = 255) -> DataFrame:
    """One class a pixel from ``(image_id, pixel, class_id, score)`` rows of overlapping masks.

    ``argmax`` takes the class of the best score, ``first`` the lowest class, ``highest`` the highest.
    A row with a null class marks a pixel that may have none.
    """
    pick = {"argmax": F.max_by("class_id", F.when(F.col("class_id").isNotNull(), F.struct("score", -F.col("class_id")))), "first": F.min("class_id"), "highest": F.max("class_id")}[how]
    return pixels.groupBy("image_id", "pixel").agg(F.coalesce(pick, F.lit(unlabelled)).alias("dt_class"))
