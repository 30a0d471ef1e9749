"""Calibration of scores: reliability bins, ECE and MCE, by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard.errors import InvalidConfig
from pixelyard.functions.numeric import linspace
from pixelyard.operators.curves import running

Z = 1.959963984540054


def scored(matches: DataFrame, iou_idx: int, min_score: float = 0.05) -> DataFrame:
    """``category_id, image_id, score, correct`` of the detections of all areas that count at a threshold."""
    hit, ign = F.shiftright(F.col("matched")[0], iou_idx), F.shiftright(F.col("ignored")[0], iou_idx)
    rows = matches.where(ign.bitwiseAND(F.lit(1)) == 0)
    # read for the edges and again for the bins
    return rows.select("category_id", "image_id", "score", hit.bitwiseAND(F.lit(1)).cast("double").alias("correct")).where(F.col("score") >= min_score).persist()


def quantiles(df: DataFrame, name: str, shares: list[float], split: bool | None = None) -> list[float]:
    """Linear quantiles: distinct values are counted, numbered in order, and only those at the wanted places are collected."""
    total = df.count()
    if not total:
        return []
    places = [q * (total - 1) for q in shares]
    wanted = sorted({int(p) for p in places} | {min(int(p) + 1, total - 1) for p in places})
    counts = df.groupBy(F.col(name).alias("v")).agg(F.count("*").alias("c")).withColumn("one", F.lit(1))
    ends = running(counts, ["one"], [F.asc("v")], {"upto": F.col("c")}, split)
    inside = [(F.col("upto") > w) & (F.col("upto") - F.col("c") <= w) for w in wanted]
    rows = ends.select("v", F.array_compact(F.array(*[F.when(i, F.lit(w)) for i, w in zip(inside, wanted, strict=True)])).alias("at")).where(F.size("at") > 0).collect()
    value = {w: r["v"] for r in rows for w in r["at"]}
    out = []
    for p in places:
        lo = int(p)
        a, b, t = value[lo], value[min(lo + 1, total - 1)], p - lo
        out.append(b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t)
    return out


def edges(dets: DataFrame, n_bins: int = 15, binning: str = "quantile", min_score: float = 0.05) -> list[float]:
    if n_bins < 1:
        raise InvalidConfig("n_bins must be positive")
    if binning == "quantile":
        raw = quantiles(dets, "score", [i / n_bins for i in range(n_bins + 1)])
    elif binning == "equal_width":
        least = dets.agg(F.min("score")).first()[0]
        raw = [] if least is None else list(linspace(max(least, min_score), 1.0, n_bins + 1))
    else:
        raise InvalidConfig(f"unknown binning {binning!r}")
    return [e for i, e in enumerate(raw) if i == 0 or e != raw[i - 1]]


def _wilson(p: Column, n: Column, sign: int) -> Column:
    d = 1 + Z * Z / n
    return (p + Z * Z / (2 * n) + sign * Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / d


def reliability(dets: DataFrame, bounds: list[float], by: list[str] | None = None, confidence: str = "wilson") -> DataFrame:
    """``bin_id, score_lo, score_hi, mean_score, accuracy, count, gap, ci_lo, ci_hi`` a bin; the last bin is closed above."""
    if confidence != "wilson":
        raise InvalidConfig("only Wilson intervals are implemented")
    by = by or []
    spark, n = dets.sparkSession, len(bounds) - 1
    bins = spark.createDataFrame([(i, bounds[i], bounds[i + 1]) for i in range(n)], "bin_id int, score_lo double, score_hi double")
    array = F.array(*[F.lit(float(e)) for e in bounds]) if bounds else F.array()
    place = F.least(F.size(F.filter(array, lambda e: e <= F.col("score"))) - 1, F.lit(n - 1))
    inside = dets.where(F.col("score").between(bounds[0], bounds[-1])) if n > 0 else dets.where(F.lit(False))
    found = inside.withColumn("bin_id", place).groupBy(*by, "bin_id").agg(F.avg("score").alias("mean_score"), F.avg("correct").alias("accuracy"), F.count("*").alias("count"))
    joined = F.broadcast(bins).join(found, "bin_id", "left" if not by else "inner").withColumn("count", F.coalesce("count", F.lit(0)))
    p, k = F.col("accuracy"), F.col("count")
    return joined.select(*by, "bin_id", "score_lo", "score_hi", "mean_score", "accuracy", "count", (p - F.col("mean_score")).alias("gap"), F.greatest(_wilson(p, k, -1), F.lit(0.0) * p).alias("ci_lo"), F.least(_wilson(p, k, 1), F.lit(1.0) + F.lit(0.0) * p).alias("ci_hi"))


def errors(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``ece, mce, n`` from reliability bins."""
    gap = F.abs("gap")
    return table.where("count > 0").groupBy(*(by or [])).agg((F.sum(F.col("count") * gap) / F.sum("count")).alias("ece"), F.max(gap).alias("mce"), F.sum("count").cast("long").alias("n"))


def worst(table: DataFrame, k: int) -> DataFrame:
    """The ``k`` bins with the largest gaps."""
    return table.where("count > 0").orderBy(F.desc(F.abs("gap")), "bin_id").limit(k)
