"""Summary lines, per-class and flat metrics from lane values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.plans.params import Line, Params


def lines(values: DataFrame, params: Params, plan: Sequence[Line], categories: DataFrame | None = None, extra: list[str] | None = None) -> DataFrame:
    """``ord, metric, iou, area, max_dets, value``: one aggregation over lane values; null where no lane has a value.

    Beside a key column called ``value``, a slice's, the last one is called ``result``.
    """
    extra = extra or []
    name = "result" if "value" in extra else "value"
    if any(line.frequency for line in plan):
        values = values.join(categories.select("category_id", "frequency"), "category_id", "left")
    parts = []
    for i, line in enumerate(plan):
        cap = line.cap_index(params.max_dets)
        here = (F.col("area_idx") == params.area_index(line.area)) & (F.col("m_idx") == (-1 if cap is None else cap))
        if line.iou is not None:
            here &= F.col("t_idx") == params.iou_index(line.iou)
        if line.frequency:
            here &= F.col("frequency") == line.frequency
        parts.append(F.avg(F.when(here, F.col("ap" if line.metric == "AP" else "ar"))).alias(f"v{i}"))
    one = values.groupBy(*extra).agg(*parts)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(line.metric).alias("metric"),
                F.lit(line.iou).cast("double").alias("iou"),
                F.lit(line.area).alias("area"),
                F.lit(params.max_dets[line.cap_index(params.max_dets)] if line.cap_index(params.max_dets) is not None else line.cap[1]).alias("max_dets"),
                F.lit(line.frequency).cast("string").alias("frequency"),
                F.col(f"v{i}").alias(name),
            )
            for i, line in enumerate(plan)
        ]
    )
    return one.select(*extra, F.explode(rows).alias("x")).select(*extra, "x.*")


def per_class(values: DataFrame, params: Params, extra: list[str] | None = None) -> DataFrame:
    """Nine metrics a category, at the largest cap."""
    m = F.col("m_idx") == len(params.max_dets) - 1
    a = lambda label: m & (F.col("area_idx") == params.area_index(label))
    known = {x.label for x in params.areas}
    out = [F.avg(F.when(a("all"), F.col("ap"))).alias("ap")]
    for name, iou in (("ap50", 0.5), ("ap75", 0.75)):
        if any(abs(t - iou) <= 1e-12 for t in params.iou_thresholds):
            out.append(F.avg(F.when(a("all") & (F.col("t_idx") == params.iou_index(iou)), F.col("ap"))).alias(name))
    out += [F.avg(F.when(a(x), F.col("ap"))).alias(f"ap_{x}") for x in ("small", "medium", "large") if x in known]
    out += [F.avg(F.when(a("all") & True, F.col("ar"))).alias("ar")]
    out += [F.avg(F.when(a(x), F.col("ar"))).alias(f"ar_{x}") for x in ("small", "medium", "large") if x in known]
    return values.groupBy(*(extra or []), "category_id").agg(*out)


def text(rows: DataFrame) -> list[str]:
    """The customary text of detection summary lines; -1 stands for no value."""
    out = []
    for r in rows.orderBy("ord").collect():
        title = "Average Precision" if r["metric"] == "AP" else "Average Recall"
        iou = "0.50:0.95" if r["iou"] is None else f"{r['iou']:0.2f}"
        value = -1.0 if r["value"] is None else r["value"]
        out.append(f" {title:<18} ({r['metric']}) @[ IoU={iou:<9} | area={r['area']:>6s} | maxDets={r['max_dets']:>3d} ] = {value:0.3f}")
    return out


def canonical_name(metric: str, iou: float | None, area: str, cap: int) -> str:
    span = "0.50:0.95" if iou is None else f"{iou:.2f}"
    return f"{metric}_{span}_{area}_{cap}"


#: Short names of the customary lines.
ALIASES = {
    "AP": "AP_0.50:0.95_all_100",
    "AP50": "AP_0.50_all_100",
    "AP75": "AP_0.75_all_100",
    "APs": "AP_0.50:0.95_small_100",
    "APm": "AP_0.50:0.95_medium_100",
    "APl": "AP_0.50:0.95_large_100",
    "AR1": "AR_0.50:0.95_all_1",
    "AR10": "AR_0.50:0.95_all_10",
    "AR100": "AR_0.50:0.95_all_100",
    "ARs": "AR_0.50:0.95_small_100",
    "ARm": "AR_0.50:0.95_medium_100",
    "ARl": "AR_0.50:0.95_large_100",
}


def canonical(name: str) -> str:
    return ALIASES.get(name, name)


def lrp_text(report: DataFrame) -> list[str]:
    """The means of an optimal LRP report, a line each."""
    r = report.first()
    titles = (("olrp", "Optimal LRP"), ("olrp_loc", "Optimal LRP Loc"), ("olrp_fp", "Optimal LRP FP"), ("olrp_fn", "Optimal LRP FN"))
    return [f" {title:<16} = {r[name]:0.3f}" for name, title in titles]
