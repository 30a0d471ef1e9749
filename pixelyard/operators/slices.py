"""Scenario slices: sets of images by axis and value, and what is aggregated over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.errors import InvalidConfig, TooManySlices

UNASSIGNED, SEPARATOR, SLICE_CAP = "__unassigned__", "::", 256


def slices(manifest: DataFrame, images: DataFrame, cross: tuple[tuple[str, ...], ...] = (), cap: int = SLICE_CAP) -> DataFrame:
    """``axis, value, image_id`` of ``manifest(key, axis columns..)``.

    Images that an axis gives no value are its ``__unassigned__`` slice. ``cross`` adds joint axes whose
    values are joined by ``::``; an image that lacks one of them is unassigned there.
    """
    axes = [c for c in manifest.columns if c != "key"]
    unknown = {a for joint in cross for a in joint} - set(axes)
    if not axes or unknown:
        raise InvalidConfig(f"the manifest has no axis {sorted(unknown) or ''}")
    known = images.select(F.col("image_id").alias("key")).distinct().join(manifest, "key", "left")
    pair = lambda name, value: F.struct(F.lit(name).alias("axis"), F.coalesce(value, F.lit(UNASSIGNED)).alias("value"))
    parts = [pair(a, F.col(a).cast("string")) for a in axes]
    for joint in cross:
        value = F.when(F.forall(F.array(*[F.col(a).isNotNull() for a in joint]), lambda x: x), F.concat_ws(SEPARATOR, *[F.col(a).cast("string") for a in joint]))
        parts.append(pair(SEPARATOR.join(joint), value))
    out = known.select(F.col("key").alias("image_id"), F.explode(F.array(*parts)).alias("x")).select("x.axis", "x.value", "image_id").distinct()
    if len(out.select("axis", "value").where(F.col("value") != UNASSIGNED).distinct().limit(cap + 1).collect()) > cap:
        raise TooManySlices(f"more than {cap} slices")
    return out


def with_overall(parts: DataFrame, images: DataFrame) -> DataFrame:
    """The slices and one of all images, ``overall``."""
    return parts.unionByName(images.select(F.lit("overall").alias("axis"), F.lit("all").alias("value"), "image_id").distinct())


def fan_out(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` of images once for each slice of their image, with ``axis`` and ``value``."""
    return rows.join(parts, "image_id")


def robustness(results: DataFrame, metric: str, baseline: tuple[str, str]) -> DataFrame:
    """``axis, mpc, rpc``: the mean of a metric over an axis's values, and that mean relative to the baseline slice."""
    axis, value = baseline
    clean = results.where((F.col("axis") == axis) & (F.col("value") == value)).agg(F.max(metric).alias("clean"))
    means = results.where((F.col("axis") != axis) & (F.col("value") != UNASSIGNED)).groupBy("axis").agg(F.avg(metric).alias("mpc"))
    return means.join(F.broadcast(clean)).select("axis", "mpc", F.when(F.col("clean") != 0, F.col("mpc") / F.col("clean")).alias("rpc"))
