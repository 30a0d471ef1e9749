"""Registered queries over the driver's tables, and the SQL that checks them.

The tables hold no images. Ground truth boxes come from ``lineitem``, detections are shifted copies
with drops, duplicates and wrong classes, all by integer and double expressions that both engines
evaluate alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelyard.functions.geometry import COCO_SIGMAS, box, oks
from pixelyard.operators import calibration, curves, diagnostics, federated, masks, matching, panoptic, semantic, slices, summary, tables
from pixelyard.plans.params import AREAS, Params, coco_plan
from pixelyard.sources import coco, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARAMS = Params()

#: Ground truth and detections in SQL; the same text runs in both engines.
GT_SQL = """
 SELECT ann_id, image_id, category_id, x, y, w, h, w * h AS area, iscrowd FROM (
  SELECT l_orderkey * 10 + l_linenumber AS ann_id, l_orderkey % 5000 AS image_id, min(l_partkey) % 5 AS category_id,
         CAST((min(l_suppkey) * 37) % 400 AS DOUBLE) AS x, CAST((min(l_partkey) * 17) % 300 AS DOUBLE) AS y,
         CAST(min(l_quantity) AS DOUBLE) + 8.0E0 AS w, CAST(min(l_quantity) AS DOUBLE) * 5.0E-1 + 1.0E1 AS h,
         min(l_partkey) % 17 = 0 AS iscrowd
  FROM lineitem GROUP BY l_orderkey, l_linenumber) g0"""
DT_SQL = """
 SELECT ann_id * 2 AS dt_id, image_id, CASE WHEN ann_id % 11 = 0 THEN (category_id + 1) % 5 ELSE category_id END AS category_id,
        x + (ann_id % 7 - 3) AS x, y + (ann_id % 5 - 2) AS y, w, h, w * h AS area, CAST((ann_id * 7919) % 1000 AS DOUBLE) / 1.0E3 AS score
 FROM gt WHERE ann_id % 6 <> 0
 UNION ALL
 SELECT ann_id * 2 + 1, image_id, category_id, x + 5.0E0, y + 4.0E0, w, h, w * h, CAST((ann_id * 104729) % 1000 AS DOUBLE) / 1.0E3
 FROM gt WHERE ann_id % 9 = 0"""


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("double").alias("q"))
    ann = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    w, h = F.col("q") + 8.0, F.col("q") * 0.5 + 10.0
    x, y = ((F.col("s") * 37) % 400).cast("double"), ((F.col("p") * 17) % 300).cast("double")
    return line.select(
        ann.alias("ann_id"),
        (F.col("l_orderkey") % 5000).cast("long").alias("image_id"),
        (F.col("p") % 5).cast("long").alias("category_id"),
        box(x, y, w, h).alias("bbox"),
        (w * h).alias("area"),
        (F.col("p") % 17 == 0).alias("iscrowd"),
        F.lit(None).cast("boolean").alias("ignore"),
        ann.alias("ord"),
    )


def detections(gt: DataFrame) -> DataFrame:
    n, b = F.col("ann_id"), F.col("bbox")
    shifted = gt.where(n % 6 != 0).select(
        (n * 2).alias("dt_id"),
        "image_id",
        F.when(n % 11 == 0, (F.col("category_id") + 1) % 5).otherwise(F.col("category_id")).alias("category_id"),
        box(b["x"] + (n % 7 - 3), b["y"] + (n % 5 - 2), b["w"], b["h"]).alias("bbox"),
        "area",
        ((n * 7919 % 1000).cast("double") / 1000.0).alias("score"),
    )
    again = gt.where(n % 9 == 0).select((n * 2 + 1).alias("dt_id"), "image_id", "category_id", box(b["x"] + 5.0, b["y"] + 4.0, b["w"], b["h"]).alias("bbox"), "area", ((n * 104729 % 1000).cast("double") / 1000.0).alias("score"))
    both = shifted.unionByName(again)
    return both.withColumn("ord", F.col("dt_id"))


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gt = ground_truth(spark, sf_dir)
    return matching.effective_ignore(gt, PARAMS.mode), detections(gt)


def matched(spark: SparkSession, sf_dir: str, params: Params = PARAMS) -> tuple[DataFrame, DataFrame]:
    """``matches`` and the ground truth counts."""
    gt, dt = inputs(spark, sf_dir)
    return matching.match(gt, matching.top_k(dt, params.max_dets[-1]), params), matching.ground_truth_counts(gt, params)


def _base(*more: str) -> str:
    return "WITH " + "RECURSIVE " * any("RECURSE" in m for m in more) + f"gt AS ({GT_SQL}), dt AS ({DT_SQL})" + "".join(", " + m.replace("/*RECURSE*/", "") for m in more)


@query("scan_gt", _base() + " SELECT ann_id, image_id, category_id, x, y, w, h, area, iscrowd FROM gt")
def scan_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground_truth(spark, sf_dir).select("ann_id", "image_id", "category_id", "bbox.*", "area", "iscrowd")


@query("scan_dt", _base() + " SELECT dt_id, image_id, category_id, x, y, w, h, area, score FROM dt")
def scan_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(ground_truth(spark, sf_dir)).select("dt_id", "image_id", "category_id", "bbox.*", "area", "score")


_INTER = "greatest(0.0E0, least(g.x + g.w, d.x + d.w) - greatest(g.x, d.x)) * greatest(0.0E0, least(g.y + g.h, d.y + d.h) - greatest(g.y, d.y))"
PAIRS = f"""ranked AS (SELECT * FROM (SELECT dt.*, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, dt_id) AS rnk FROM dt) r0 WHERE rnk <= 100),
pairs AS (SELECT image_id, category_id, dt_id, ann_id, rnk, score, d_area, g_area, iscrowd,
   CASE WHEN iscrowd THEN inter / d_area ELSE inter / (g_area + d_area - inter) END AS iou
 FROM (SELECT d.image_id, d.category_id, d.dt_id, g.ann_id, d.rnk, d.score, d.area AS d_area, g.area AS g_area, g.iscrowd, {_INTER} AS inter
       FROM ranked d JOIN gt g ON d.image_id = g.image_id AND d.category_id = g.category_id) p0)"""


@query("bbox_iou_pairs", _base(PAIRS) + " SELECT image_id, category_id, dt_id, ann_id, round(iou, 9) AS iou FROM pairs WHERE iou >= 1.0E-1")
def bbox_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, dt = inputs(spark, sf_dir)
    return matching.pairs(gt, matching.top_k(dt, 100)).withColumn("iou", F.round("iou", 9))


@query("topk_per_cell", _base() + " SELECT dt_id, rnk FROM (SELECT dt_id, CAST(row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, dt_id) AS INTEGER) AS rnk FROM dt) x WHERE rnk <= 2")
def topk_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.top_k(detections(ground_truth(spark, sf_dir)), 2).select("dt_id", F.col("rank").alias("rnk"))


@query("lvis_trim", _base() + " SELECT dt_id, rnk FROM (SELECT dt_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, dt_id) AS INTEGER) AS rnk FROM dt) x WHERE rnk <= 5")
def lvis_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.top_k(detections(ground_truth(spark, sf_dir)), 5, ["image_id"]).select("dt_id", F.col("rank").alias("rnk"))


#: The greedy match in SQL: a step takes each cell's next detection that has a candidate left.
def _match_sql(thresholds: str, areas: str) -> str:
    return f"""{PAIRS},
ts AS (SELECT * FROM (VALUES {thresholds}) t(t_idx, thr)),
ars AS (SELECT * FROM (VALUES {areas}) a(area_idx, lo, hi)),
edges AS (SELECT t_idx, thr, area_idx, image_id, category_id, dt_id, rnk, ann_id, iou, iscrowd, (iscrowd OR g_area < lo OR g_area > hi) AS ign
          FROM pairs, ts, ars WHERE iou >= thr),
firsts AS (SELECT t_idx, area_idx, image_id, category_id, rnk, dt_id,
             row_number() OVER (PARTITION BY t_idx, area_idx, image_id, category_id ORDER BY rnk) AS k,
             list({{'i': ign, 'v': -iou, 'g': -ann_id, 'c': iscrowd}} ORDER BY ign, iou DESC, ann_id DESC) AS es
           FROM edges GROUP BY t_idx, area_idx, image_id, category_id, rnk, dt_id),
/*RECURSE*/steps AS (
  SELECT t_idx, area_idx, image_id, category_id, k, dt_id, es[1] AS pick, [-es[1].g] AS taken FROM firsts WHERE k = 1
  UNION ALL
  SELECT f.t_idx, f.area_idx, f.image_id, f.category_id, f.k, f.dt_id,
         list_filter(f.es, lambda e: e.c OR NOT list_contains(s.taken, -e.g))[1] AS pick,
         list_append(s.taken, -(list_filter(f.es, lambda e: e.c OR NOT list_contains(s.taken, -e.g))[1]).g) AS taken
  FROM steps s JOIN firsts f ON f.t_idx = s.t_idx AND f.area_idx = s.area_idx AND f.image_id = s.image_id AND f.category_id = s.category_id AND f.k = s.k + 1),
hits AS (SELECT t_idx, area_idx, dt_id, -pick.g AS ann_id, pick.i AS ign FROM steps WHERE pick IS NOT NULL),
matches AS (SELECT r.image_id, r.category_id, r.dt_id, r.score, r.rnk, ts.t_idx, ars.area_idx, h.ann_id, h.ann_id IS NOT NULL AS matched,
              CASE WHEN h.ann_id IS NOT NULL THEN h.ign ELSE (r.area < lo OR r.area > hi) END AS ignored
            FROM ranked r CROSS JOIN ts CROSS JOIN ars LEFT JOIN hits h ON h.dt_id = r.dt_id AND h.t_idx = ts.t_idx AND h.area_idx = ars.area_idx)"""


def _values(items: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, int) else f"{x!r}E0" if "e" not in repr(x) else repr(x) for x in item) + ")" for item in items)


ALL_AREA = _values([(0, 0.0, 1e10)])
T50 = _values([(0, 0.5)])
LADDER = _values(list(enumerate(PARAMS.seeds)))
FOUR_AREAS = _values([(i, a.lo, a.hi) for i, a in enumerate(AREAS)])
ONE = Params(iou_thresholds=(0.5,), areas=AREAS[:1], max_dets=(100,))
LADDER_ONE = Params(areas=AREAS[:1], max_dets=(100,))


def match_rows(matches: DataFrame) -> DataFrame:
    """``matches`` as rows of (detection, area range, threshold)."""
    by_area = matches.select("image_id", "category_id", "dt_id", "score", "rank", F.posexplode(F.arrays_zip("matched", "ignored", "gts")).alias("area_idx", "x"))
    n = by_area.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(PARAMS.iou_thresholds) - 1))).alias("t_idx"))
    return n.select("image_id", "category_id", "dt_id", "score", "rank", "area_idx", "t_idx", F.expr("shiftright(x.matched, t_idx) & 1 = 1").alias("matched"), F.expr("shiftright(x.ignored, t_idx) & 1 = 1").alias("ignored"), F.expr("get(x.gts, t_idx)").alias("ann_id"))


@query("match_t50", _base(_match_sql(T50, ALL_AREA)) + " SELECT dt_id, coalesce(ann_id, -1) AS ann_id, matched, ignored FROM matches")
def match_t50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_rows(matched(spark, sf_dir, ONE)[0]).where("t_idx = 0").select("dt_id", F.coalesce("ann_id", F.lit(-1)).alias("ann_id"), "matched", "ignored")


@query("match_ladder", _base(_match_sql(LADDER, FOUR_AREAS)) + " SELECT area_idx, t_idx, category_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE matched) AS BIGINT) AS n_matched, CAST(count(*) FILTER (WHERE ignored) AS BIGINT) AS n_ignored, CAST(sum(coalesce(ann_id, 0)) AS BIGINT) AS ann_sum FROM matches GROUP BY ALL")
def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match_rows(matched(spark, sf_dir)[0])
    return rows.groupBy("area_idx", "t_idx", "category_id").agg(F.count("*").alias("n"), F.count_if("matched").alias("n_matched"), F.count_if("ignored").alias("n_ignored"), F.coalesce(F.sum("ann_id"), F.lit(0)).cast("long").alias("ann_sum"))


CURVE = """npig AS (SELECT category_id, area_idx, count(*) AS npig FROM gt, ars WHERE NOT iscrowd AND gt.area >= lo AND gt.area <= hi GROUP BY ALL),
caps AS (SELECT * FROM (VALUES {caps}) c(m_idx, cap)),
run AS (SELECT category_id, area_idx, m_idx, t_idx, score, matched AND NOT ignored AS is_tp,
          sum(CASE WHEN matched AND NOT ignored THEN 1 ELSE 0 END) OVER w AS tp, sum(CASE WHEN NOT matched AND NOT ignored THEN 1 ELSE 0 END) OVER w AS fp
        FROM matches JOIN caps ON rnk <= cap WINDOW w AS (PARTITION BY category_id, area_idx, m_idx, t_idx ORDER BY score DESC, image_id, rnk ROWS UNBOUNDED PRECEDING)),
pr0 AS (SELECT run.*, tp / CAST(npig AS DOUBLE) AS rc, CAST(tp AS DOUBLE) / (CAST(tp + fp AS DOUBLE) + 2.220446049250313E-16) AS p FROM run JOIN npig USING (category_id, area_idx) WHERE is_tp),
rs AS (SELECT i AS r_idx, CASE WHEN i = 100 THEN 1.0E0 ELSE i * (1.0E0 / 100) END AS r FROM range(0, 101) x(i)),
reach AS (SELECT pr0.*, (SELECT max(r_idx) FROM rs WHERE r <= rc) AS b FROM pr0),
best AS (SELECT category_id, area_idx, m_idx, t_idx, b, max(p) AS p FROM reach GROUP BY ALL),
sparse AS (SELECT category_id, area_idx, m_idx, t_idx, r_idx, max(p) AS precision FROM best JOIN rs ON b >= r_idx GROUP BY ALL),
grid AS (SELECT category_id, area_idx, m_idx, t_idx FROM npig CROSS JOIN caps CROSS JOIN ts),
lanes AS (SELECT g.*, coalesce(a.ap, 0.0E0) AS ap, coalesce(r.ar, 0.0E0) AS ar FROM grid g
  LEFT JOIN (SELECT category_id, area_idx, m_idx, t_idx, sum(precision) / 101 AS ap FROM sparse GROUP BY ALL) a USING (category_id, area_idx, m_idx, t_idx)
  LEFT JOIN (SELECT category_id, area_idx, m_idx, t_idx, max(rc) AS ar FROM pr0 GROUP BY ALL) r USING (category_id, area_idx, m_idx, t_idx))"""
CAPS = _values([(i, m) for i, m in enumerate(PARAMS.max_dets)])


@query("pr_curve", _base(_match_sql(LADDER, ALL_AREA), CURVE.format(caps="(0, 100)")) + " SELECT category_id, t_idx, CAST(r_idx AS INTEGER) AS r_idx, round(precision, 9) AS precision FROM sparse")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr, _ = curves.curve(*matched(spark, sf_dir, LADDER_ONE), LADDER_ONE)
    return pr.select("category_id", "t_idx", "r_idx", F.round("precision", 9).alias("precision"))


def lane_values(spark: SparkSession, sf_dir: str, params: Params = PARAMS) -> DataFrame:
    return curves.lane_values(*matched(spark, sf_dir, params), params)


@query("ap_per_class", _base(_match_sql(LADDER, FOUR_AREAS), CURVE.format(caps=CAPS)) + """
 SELECT category_id, round(avg(ap) FILTER (WHERE area_idx = 0 AND m_idx = 2), 9) AS ap, round(avg(ap) FILTER (WHERE area_idx = 0 AND m_idx = 2 AND t_idx = 0), 9) AS ap50,
  round(avg(ap) FILTER (WHERE area_idx = 0 AND m_idx = 2 AND t_idx = 5), 9) AS ap75, round(avg(ap) FILTER (WHERE area_idx = 1 AND m_idx = 2), 9) AS ap_small,
  round(avg(ap) FILTER (WHERE area_idx = 2 AND m_idx = 2), 9) AS ap_medium, round(avg(ap) FILTER (WHERE area_idx = 3 AND m_idx = 2), 9) AS ap_large,
  round(avg(ar) FILTER (WHERE area_idx = 0 AND m_idx = 2), 9) AS ar, round(avg(ar) FILTER (WHERE area_idx = 1 AND m_idx = 2), 9) AS ar_small,
  round(avg(ar) FILTER (WHERE area_idx = 2 AND m_idx = 2), 9) AS ar_medium, round(avg(ar) FILTER (WHERE area_idx = 3 AND m_idx = 2), 9) AS ar_large
 FROM lanes GROUP BY category_id""")
def ap_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = summary.per_class(lane_values(spark, sf_dir), PARAMS)
    return table.select("category_id", *[F.round(c, 9).alias(c) for c in table.columns[1:]])


def _summary_sql() -> str:
    rows = []
    for i, line in enumerate(coco_plan()):
        m, a = line.cap_index(PARAMS.max_dets), PARAMS.area_index(line.area)
        iou = "" if line.iou is None else f" AND t_idx = {PARAMS.iou_index(line.iou)}"
        rows.append(f"SELECT {i} AS ord, '{line.metric}' AS metric, CAST({'NULL' if line.iou is None else line.iou} AS DOUBLE) AS iou, '{line.area}' AS area, {PARAMS.max_dets[m]} AS max_dets, round(avg({line.metric.lower()}), 9) AS value FROM lanes WHERE area_idx = {a} AND m_idx = {m}{iou}")
    return " UNION ALL ".join(rows)


@query("coco_summary_12", _base(_match_sql(LADDER, FOUR_AREAS), CURVE.format(caps=CAPS)) + _summary_sql())
def coco_summary_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.lines(lane_values(spark, sf_dir), PARAMS, coco_plan()).select("ord", "metric", "iou", "area", "max_dets", F.round("value", 9).alias("value"))


# ------------------------------------------------------------------- tables


@query("per_image_table", _base(_match_sql(_values([(0, 0.5), (5, 0.75)]), ALL_AREA)) + """,
 n AS (SELECT image_id, count(*) AS n_gt FROM gt WHERE NOT iscrowd GROUP BY 1),
 m AS (SELECT image_id, count(*) FILTER (WHERE t_idx = 0) AS n_dt, count(*) FILTER (WHERE t_idx = 0 AND matched AND NOT ignored) AS tp_50, count(*) FILTER (WHERE t_idx = 0 AND NOT matched AND NOT ignored) AS fp_50,
   count(*) FILTER (WHERE t_idx = 5 AND matched AND NOT ignored) AS tp_75, count(*) FILTER (WHERE t_idx = 5 AND NOT matched AND NOT ignored) AS fp_75 FROM matches GROUP BY 1)
 SELECT i.image_id, coalesce(n_gt, 0) AS n_gt, coalesce(n_dt, 0) AS n_dt, coalesce(tp_50, 0) AS tp_50, coalesce(fp_50, 0) AS fp_50, greatest(coalesce(n_gt, 0) - coalesce(tp_50, 0), 0) AS fn_50,
  coalesce(tp_75, 0) AS tp_75, coalesce(fp_75, 0) AS fp_75, greatest(coalesce(n_gt, 0) - coalesce(tp_75, 0), 0) AS fn_75
 FROM (SELECT DISTINCT image_id FROM gt) i LEFT JOIN n USING (image_id) LEFT JOIN m USING (image_id)""")
def per_image_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = PARAMS.but(areas=AREAS[:1])
    gt, _ = inputs(spark, sf_dir)
    return tables.per_image(gt.select("image_id").distinct(), gt, matched(spark, sf_dir, params)[0], params).drop("tp_mean")


@query("per_detection", _base(_match_sql(T50, ALL_AREA)) + """,
 b AS (SELECT dt_id, max(iou) AS best FROM pairs WHERE iou >= 1.0E-1 GROUP BY 1)
 SELECT dt_id, image_id, category_id, score, CASE WHEN ignored THEN 'ignored' WHEN matched THEN 'tp' ELSE 'fp' END AS status, coalesce(ann_id, -1) AS gt_id, round(coalesce(best, -1.0E0), 9) AS best_iou FROM matches LEFT JOIN b USING (dt_id)""")
def per_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, dt = inputs(spark, sf_dir)
    pairs = matching.pairs(gt, matching.top_k(dt, 100))
    table = tables.per_detection(matched(spark, sf_dir, ONE)[0], pairs, ONE)
    return table.select("dt_id", "image_id", "category_id", "score", "status", F.coalesce("gt_id", F.lit(-1)).alias("gt_id"), F.round(F.coalesce("best_iou", F.lit(-1.0)), 9).alias("best_iou"))


@query("area_breakdown", _base() + f" SELECT category_id, CAST(area_idx AS INTEGER) AS area_idx, CAST(count(*) FILTER (WHERE NOT iscrowd AND area >= lo AND area <= hi) AS BIGINT) AS npig FROM gt, (VALUES {FOUR_AREAS}) a(area_idx, lo, hi) GROUP BY ALL")
def area_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ground_truth_counts(inputs(spark, sf_dir)[0], PARAMS)


# ------------------------------------------------------------------- slices

_MANIFEST_SQL = "SELECT o_orderkey % 5000 AS image_id, min(o_orderpriority) AS priority, min(o_orderstatus) AS status FROM orders GROUP BY 1"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 5000).cast("long").alias("key")).agg(F.min("o_orderpriority").alias("priority"), F.min("o_orderstatus").alias("status"))


def sliced(spark: SparkSession, sf_dir: str, cross: tuple = ()) -> DataFrame:
    gt, _ = inputs(spark, sf_dir)
    parts = slices.slices(manifest(spark, sf_dir), gt.select("image_id"), cross)
    matches, _ = matched(spark, sf_dir, LADDER_ONE)
    key = ["axis", "value"]
    a = LADDER_ONE.areas[0]
    counted = slices.fan_out(gt.where(~F.col("ign") & F.col("area").between(a.lo, a.hi)), parts)
    npig = counted.groupBy(*key, "category_id").agg(F.count("*").alias("npig")).withColumn("area_idx", F.lit(0))
    return curves.lane_values(slices.fan_out(matches, parts), npig, LADDER_ONE, key).groupBy(*key).agg(F.avg("ap").alias("ap"), F.avg("ar").alias("ar"))


def _slice_sql(parts: str) -> str:
    return _base(_match_sql(LADDER, ALL_AREA)) + f""",
 man AS ({_MANIFEST_SQL}),
 known AS (SELECT i.image_id, priority, status FROM (SELECT DISTINCT image_id FROM gt) i LEFT JOIN man USING (image_id)),
 parts AS ({parts}),
 npig AS (SELECT axis, value, category_id, count(*) AS npig FROM gt JOIN parts USING (image_id) WHERE NOT iscrowd GROUP BY ALL),
 run AS (SELECT axis, value, category_id, t_idx, matched AND NOT ignored AS is_tp,
          sum(CASE WHEN matched AND NOT ignored THEN 1 ELSE 0 END) OVER w AS tp, sum(CASE WHEN NOT matched AND NOT ignored THEN 1 ELSE 0 END) OVER w AS fp
        FROM matches JOIN parts USING (image_id) WINDOW w AS (PARTITION BY axis, value, category_id, t_idx ORDER BY score DESC, image_id, rnk ROWS UNBOUNDED PRECEDING)),
 pr0 AS (SELECT run.*, tp / CAST(npig AS DOUBLE) AS rc, CAST(tp AS DOUBLE) / (CAST(tp + fp AS DOUBLE) + 2.220446049250313E-16) AS p FROM run JOIN npig USING (axis, value, category_id) WHERE is_tp),
 rs AS (SELECT i AS r_idx, CASE WHEN i = 100 THEN 1.0E0 ELSE i * (1.0E0 / 100) END AS r FROM range(0, 101) x(i)),
 reach AS (SELECT pr0.*, (SELECT max(r_idx) FROM rs WHERE r <= rc) AS b FROM pr0),
 best AS (SELECT axis, value, category_id, t_idx, b, max(p) AS p FROM reach GROUP BY ALL),
 sparse AS (SELECT axis, value, category_id, t_idx, r_idx, max(p) AS precision FROM best JOIN rs ON b >= r_idx GROUP BY ALL),
 lanes AS (SELECT g.*, coalesce(a.ap, 0.0E0) AS ap, coalesce(r.ar, 0.0E0) AS ar FROM (SELECT axis, value, category_id, t_idx FROM npig CROSS JOIN ts) g
  LEFT JOIN (SELECT axis, value, category_id, t_idx, sum(precision) / 101 AS ap FROM sparse GROUP BY ALL) a USING (axis, value, category_id, t_idx)
  LEFT JOIN (SELECT axis, value, category_id, t_idx, max(rc) AS ar FROM pr0 GROUP BY ALL) r USING (axis, value, category_id, t_idx)),
 out AS (SELECT axis, value, avg(ap) AS ap, avg(ar) AS ar FROM lanes GROUP BY ALL)"""


_AXES_SQL = "SELECT 'priority' AS axis, coalesce(priority, '__unassigned__') AS value, image_id FROM known UNION ALL SELECT 'status', coalesce(status, '__unassigned__'), image_id FROM known"


@query("ap_by_slice", _slice_sql(_AXES_SQL) + " SELECT axis, value, round(ap, 9) AS ap, round(ar, 9) AS ar FROM out")
def ap_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced(spark, sf_dir).select("axis", "value", F.round("ap", 9).alias("ap"), F.round("ar", 9).alias("ar"))


@query("ap_cross_slice", _slice_sql(_AXES_SQL + " UNION ALL SELECT 'priority::status', CASE WHEN priority IS NULL OR status IS NULL THEN '__unassigned__' ELSE priority || '::' || status END, image_id FROM known") + " SELECT axis, value, round(ap, 9) AS ap FROM out")
def ap_cross_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced(spark, sf_dir, (("priority", "status"),)).select("axis", "value", F.round("ap", 9).alias("ap"))


@query("mpc_rpc", _slice_sql(_AXES_SQL) + " SELECT axis, round(avg(ap), 9) AS mpc, round(avg(ap) / (SELECT max(ap) FROM out WHERE axis = 'status' AND value = 'O'), 9) AS rpc FROM out WHERE axis <> 'status' AND value <> '__unassigned__' GROUP BY axis")
def mpc_rpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = slices.robustness(sliced(spark, sf_dir), "ap", ("status", "O"))
    return out.select("axis", F.round("mpc", 9).alias("mpc"), F.round("rpc", 9).alias("rpc"))


# -------------------------------------------------------------- calibration

_SCORED_SQL = """scored AS (SELECT category_id, score, CASE WHEN matched THEN 1.0E0 ELSE 0.0E0 END AS correct FROM matches WHERE NOT ignored AND score >= 5.0E-2),
 qs AS ({edges}),
 es AS (SELECT row_number() OVER (ORDER BY e) - 1 AS k, e FROM (SELECT DISTINCT e FROM qs)),
 bins AS (SELECT a.k AS bin_id, a.e AS lo, b.e AS hi, b.k = (SELECT max(k) FROM es) AS last FROM es a JOIN es b ON b.k = a.k + 1),
 rel AS (SELECT CAST(bin_id AS INTEGER) AS bin_id, lo, hi, avg(score) AS mean_score, avg(correct) AS accuracy, count(*) AS n FROM bins JOIN scored ON score >= lo AND (score < hi OR (last AND score <= hi)) GROUP BY ALL)"""


def _quantile_sql() -> str:
    edges = " UNION ALL ".join(f"SELECT quantile_cont(score, {i / 15!r}E0) AS e FROM scored" for i in range(16))
    return _base(_match_sql(T50, ALL_AREA), _SCORED_SQL.format(edges=edges))


@query("calibration_reliability", _quantile_sql() + " SELECT bin_id, round(lo, 9) AS score_lo, round(hi, 9) AS score_hi, round(mean_score, 9) AS mean_score, round(accuracy, 9) AS accuracy, n FROM rel")
def calibration_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = calibration.scored(matched(spark, sf_dir, ONE)[0], 0)
    table = calibration.reliability(dets, calibration.edges(dets)).where("count > 0")
    return table.select("bin_id", *[F.round(c, 9).alias(c) for c in ("score_lo", "score_hi", "mean_score", "accuracy")], F.col("count").alias("n"))


@query("calibration_errors", _quantile_sql() + " SELECT round(sum(n * abs(accuracy - mean_score)) / sum(n), 9) AS ece, round(max(abs(accuracy - mean_score)), 9) AS mce, CAST(sum(n) AS BIGINT) AS n FROM rel")
def calibration_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = calibration.scored(matched(spark, sf_dir, ONE)[0], 0)
    out = calibration.errors(calibration.reliability(dets, calibration.edges(dets)))
    return out.select(F.round("ece", 9).alias("ece"), F.round("mce", 9).alias("mce"), "n")


# -------------------------------------------------------------- diagnostics

_LRP_SQL = _match_sql(T50, ALL_AREA) + """,
 lrp AS (SELECT m.category_id, m.score, m.matched, CASE WHEN m.matched THEN p.iou ELSE 0.0E0 END AS iou FROM matches m LEFT JOIN pairs p ON p.dt_id = m.dt_id AND p.ann_id = m.ann_id WHERE NOT (m.matched AND m.ignored)),
 npos AS (SELECT category_id, count(*) AS n FROM gt WHERE NOT iscrowd GROUP BY 1),
 taus AS (SELECT i, CASE WHEN i = 100 THEN 1.0E0 ELSE i * (1.0E0 / 100) END AS tau FROM range(0, 101) x(i)),
 sweep AS (SELECT npos.category_id, n, i, count(*) FILTER (WHERE matched AND score >= tau) AS tp, count(*) FILTER (WHERE NOT matched AND score >= tau) AS fp, coalesce(sum(1.0E0 - iou) FILTER (WHERE matched AND score >= tau), 0.0E0) AS loc
   FROM npos CROSS JOIN taus LEFT JOIN lrp ON lrp.category_id = npos.category_id GROUP BY ALL),
 vals AS (SELECT *, n - tp AS fn, (loc / 5.0E-1 + fp + (n - tp)) / CAST(tp + fp + (n - tp) AS DOUBLE) AS v FROM sweep)"""


@query("lrp_optimal", _base(_LRP_SQL) + " SELECT category_id, round(min(v), 9) AS olrp FROM vals GROUP BY category_id")
def lrp_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, dt = inputs(spark, sf_dir)
    found = diagnostics.optimal_lrp(diagnostics.lrp_matches(gt, matching.top_k(dt, 100)), diagnostics.n_counting(gt))
    return found.select("category_id", F.round("olrp", 9).alias("olrp"))


_IMAGE_SQL = f"""topi AS (SELECT * FROM (SELECT dt.*, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, dt_id) AS rnk FROM dt) r0 WHERE rnk <= 100),
ipairs AS (SELECT *, inter / (g_area + d_area - inter) AS plain, CASE WHEN iscrowd THEN inter / d_area ELSE inter / (g_area + d_area - inter) END AS iou
 FROM (SELECT d.image_id, d.category_id AS d_cat, g.category_id AS g_cat, d.dt_id, g.ann_id, d.rnk, d.area AS d_area, g.area AS g_area, g.iscrowd, {_INTER} AS inter FROM topi d JOIN gt g ON d.image_id = g.image_id) p0)"""


@query("confusion_matrix_det", _base(_IMAGE_SQL + """,
 firsts AS (SELECT image_id, rnk, dt_id, d_cat, row_number() OVER (PARTITION BY image_id ORDER BY rnk) AS k, list({'v': -iou, 'g': ann_id, 'c': iscrowd, 'k': g_cat} ORDER BY iou DESC, ann_id) AS es FROM ipairs WHERE iou >= 5.0E-1 GROUP BY image_id, rnk, dt_id, d_cat),
/*RECURSE*/steps AS (
  SELECT image_id, k, dt_id, d_cat, es[1] AS pick, CASE WHEN es[1].c THEN [] ELSE [es[1].g] END AS taken FROM firsts WHERE k = 1
  UNION ALL
  SELECT f.image_id, f.k, f.dt_id, f.d_cat, list_filter(f.es, lambda e: NOT list_contains(s.taken, e.g))[1] AS pick,
    CASE WHEN coalesce((list_filter(f.es, lambda e: NOT list_contains(s.taken, e.g))[1]).c, true) THEN s.taken ELSE list_append(s.taken, (list_filter(f.es, lambda e: NOT list_contains(s.taken, e.g))[1]).g) END AS taken
  FROM steps s JOIN firsts f ON f.image_id = s.image_id AND f.k = s.k + 1),
 hits AS (SELECT dt_id, d_cat, pick.g AS ann_id, pick.k AS g_cat, pick.c AS crowd FROM steps WHERE pick IS NOT NULL),
 rows0 AS (SELECT CAST(g_cat AS VARCHAR) AS g, CAST(d_cat AS VARCHAR) AS d FROM hits WHERE NOT crowd
  UNION ALL SELECT '__none__', CAST(category_id AS VARCHAR) FROM topi WHERE dt_id NOT IN (SELECT dt_id FROM hits)
  UNION ALL SELECT CAST(category_id AS VARCHAR), '__none__' FROM gt WHERE NOT iscrowd AND ann_id NOT IN (SELECT ann_id FROM hits WHERE NOT crowd))""") + " SELECT g AS gt_class, d AS dt_class, count(*) AS n FROM rows0 GROUP BY ALL")
def confusion_matrix_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.confusion_matrix(*inputs(spark, sf_dir))


_TIDE_SQL = _base(_IMAGE_SQL + """,
 firsts AS (SELECT image_id, d_cat, rnk, dt_id, row_number() OVER (PARTITION BY image_id, d_cat ORDER BY rnk) AS k, list({'i': iscrowd, 'v': -plain, 'g': -ann_id, 'c': iscrowd} ORDER BY iscrowd, plain DESC, ann_id DESC) AS es
   FROM ipairs WHERE d_cat = g_cat AND plain >= 5.0E-1 GROUP BY image_id, d_cat, rnk, dt_id),
/*RECURSE*/steps AS (
  SELECT image_id, d_cat, k, dt_id, es[1] AS pick, [-es[1].g] AS taken FROM firsts WHERE k = 1
  UNION ALL
  SELECT f.image_id, f.d_cat, f.k, f.dt_id, list_filter(f.es, lambda e: e.c OR NOT list_contains(s.taken, -e.g))[1] AS pick,
    list_append(s.taken, -(list_filter(f.es, lambda e: e.c OR NOT list_contains(s.taken, -e.g))[1]).g) AS taken
  FROM steps s JOIN firsts f ON f.image_id = s.image_id AND f.d_cat = s.d_cat AND f.k = s.k + 1),
 hits AS (SELECT dt_id, pick.i AS ign FROM steps WHERE pick IS NOT NULL),
 tops AS (SELECT dt_id, coalesce(max(iou) FILTER (WHERE d_cat = g_cat), 0.0E0) AS s, coalesce(max(iou) FILTER (WHERE d_cat <> g_cat), 0.0E0) AS c FROM ipairs GROUP BY 1),
 binned AS (SELECT t.dt_id, t.category_id, CASE WHEN h.dt_id IS NOT NULL THEN CASE WHEN h.ign THEN 'ignore' ELSE 'tp' END WHEN coalesce(s, 0) >= 5.0E-1 THEN 'dupe' WHEN coalesce(c, 0) >= 5.0E-1 THEN 'cls'
    WHEN coalesce(s, 0) >= 1.0E-1 AND coalesce(s, 0) >= coalesce(c, 0) THEN 'loc' WHEN coalesce(c, 0) >= 1.0E-1 THEN 'both' ELSE 'bkg' END AS bin, coalesce(s, 0.0E0) AS s, coalesce(c, 0.0E0) AS c
  FROM topi t LEFT JOIN hits h USING (dt_id) LEFT JOIN tops USING (dt_id))""")


@query("tide_bins", _TIDE_SQL + " SELECT dt_id, bin FROM binned")
def tide_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.tide_bins(*inputs(spark, sf_dir))[0].select("dt_id", "bin")


@query("fp_iou_histogram", _TIDE_SQL + ", f AS (SELECT 'same' AS kind, s AS v FROM binned WHERE bin NOT IN ('tp', 'ignore') UNION ALL SELECT 'cross', c FROM binned WHERE bin NOT IN ('tp', 'ignore')) SELECT kind, CAST(least(floor(v * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM f GROUP BY ALL")
def fp_iou_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.fp_iou_histogram(diagnostics.tide_bins(*inputs(spark, sf_dir))[0])


@query("tide_deltas")
def tide_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mended versions change the inputs of the whole chain; tests hold them against single evaluations."""
    return diagnostics.error_decomposition(*inputs(spark, sf_dir), PARAMS)


# ---------------------------------------------------------------- federated

_FED_SQL = """neg AS (SELECT DISTINCT o_orderkey % 5000 AS image_id, o_custkey % 5 AS category_id FROM orders WHERE o_orderstatus = 'F'),
 nel AS (SELECT DISTINCT o_orderkey % 5000 AS image_id, o_custkey % 5 AS category_id FROM orders WHERE o_orderstatus = 'P')"""


def federated_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    cells = lambda s: orders.where(F.col("o_orderstatus") == s).select((F.col("o_orderkey") % 5000).cast("long").alias("image_id"), (F.col("o_custkey") % 5).cast("long").alias("category_id")).distinct()
    return cells("F"), cells("P")


@query("federated_match", "WITH RECURSIVE " + f"gt AS ({GT_SQL}), dt0 AS ({DT_SQL}), " + _FED_SQL + """,
 trimmed AS (SELECT * FROM (SELECT dt0.*, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, dt_id) AS r FROM dt0) x WHERE r <= 300),
 dt AS (SELECT t.dt_id, t.image_id, t.category_id, t.x, t.y, t.w, t.h, t.area, t.score FROM trimmed t SEMI JOIN (SELECT image_id, category_id FROM gt UNION SELECT image_id, category_id FROM neg) k USING (image_id, category_id)), """ + _match_sql(T50, ALL_AREA).replace("/*RECURSE*/", "") + """
 SELECT m.dt_id, matched, ignored OR (NOT matched AND n.image_id IS NOT NULL) AS ignored FROM matches m LEFT JOIN nel n ON n.image_id = m.image_id AND n.category_id = m.category_id""")
def federated_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, dt = inputs(spark, sf_dir)
    matches, _ = federated.match(gt, dt, *federated_inputs(spark, sf_dir), ONE.but(max_dets=(300,)))
    return match_rows(matches).where("t_idx = 0").select("dt_id", "matched", "ignored")


# ------------------------------------------------------------------ semantic

_RUNS_SQL = "runs AS (SELECT l_orderkey % 5000 AS image_id, CAST(CASE WHEN l_partkey % 23 = 0 THEN 255 ELSE l_partkey % 7 END AS INTEGER) AS g, CAST(CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 7 ELSE l_partkey % 7 END AS INTEGER) AS d, CAST(l_quantity AS BIGINT) AS n FROM lineitem)"
_CONF_SQL = "WITH " + _RUNS_SQL + ", conf AS (SELECT g, d, CAST(sum(n) AS BIGINT) AS n FROM runs WHERE g <> 255 AND g BETWEEN 0 AND 6 AND d BETWEEN 0 AND 6 GROUP BY ALL)"


def pixel_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5000).cast("long").alias("image_id"), F.when(p % 23 == 0, 255).otherwise(p % 7).cast("int").alias("gt_class"), F.when(s % 3 == 0, s % 7).otherwise(p % 7).cast("int").alias("dt_class"), F.col("l_quantity").cast("long").alias("n"))


@query("semantic_confusion", _CONF_SQL + " SELECT g AS gt_class, d AS dt_class, n FROM conf")
def semantic_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.confusion(pixel_runs(spark, sf_dir), 7, 255)


@query("semantic_miou", _CONF_SQL + """,
 c AS (SELECT k, (SELECT sum(n) FROM conf WHERE g = k) AS gt, (SELECT sum(n) FROM conf WHERE d = k) AS dt, (SELECT sum(n) FROM conf WHERE g = k AND d = k) AS hit FROM range(0, 7) r(k))
 SELECT round(avg(hit / CAST(gt + dt - hit AS DOUBLE)), 9) AS miou, round(sum(gt * (hit / CAST(gt + dt - hit AS DOUBLE))) / sum(gt), 9) AS fwiou, round(sum(hit) / CAST(sum(gt) AS DOUBLE), 9) AS pixel_accuracy, round(avg(hit / CAST(gt AS DOUBLE)), 9) AS mean_accuracy FROM c""")
def semantic_miou(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = semantic.summary(semantic.per_class(semantic.confusion(pixel_runs(spark, sf_dir), 7, 255), 7))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


# ------------------------------------------------------------------ panoptic

#: Each lineitem row is a run of pixels of one ground truth and one predicted segment of its image.
_PAN_SQL = """px AS (SELECT l_orderkey % 5000 AS image_id, CAST(CASE WHEN l_partkey % 29 = 0 THEN 0 ELSE l_orderkey // 5000 * 10 + l_linenumber % 2 + 1 END AS BIGINT) AS gt_id, CAST(CASE WHEN l_suppkey % 31 = 0 THEN 0 ELSE l_orderkey // 5000 * 10 + l_linenumber % 3 % 2 + 1 END AS BIGINT) AS dt_id, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
 ov AS (SELECT image_id, gt_id, dt_id, sum(n) AS n FROM px GROUP BY ALL),
 gs AS (SELECT image_id, gt_id, gt_id % 4 AS cat, gt_id % 13 = 5 AS crowd, sum(n) AS area FROM px WHERE gt_id <> 0 GROUP BY ALL),
 ds AS (SELECT image_id, dt_id, CASE WHEN dt_id % 7 = 3 THEN (dt_id + 1) % 4 ELSE dt_id % 4 END AS cat, sum(n) AS area FROM px WHERE dt_id <> 0 GROUP BY ALL),
 void AS (SELECT image_id, dt_id, n AS void FROM ov WHERE gt_id = 0),
 tp AS (SELECT o.image_id, o.gt_id, o.dt_id, g.cat, o.n / CAST(g.area + d.area - o.n - coalesce(v.void, 0) AS DOUBLE) AS iou FROM ov o JOIN gs g ON g.image_id = o.image_id AND g.gt_id = o.gt_id AND NOT g.crowd JOIN ds d ON d.image_id = o.image_id AND d.dt_id = o.dt_id AND d.cat = g.cat
   LEFT JOIN void v ON v.image_id = o.image_id AND v.dt_id = o.dt_id WHERE o.n / CAST(g.area + d.area - o.n - coalesce(v.void, 0) AS DOUBLE) > 5.0E-1),
 cov AS (SELECT o.image_id, o.dt_id, sum(o.n) AS c FROM ov o JOIN ds d ON d.image_id = o.image_id AND d.dt_id = o.dt_id LEFT JOIN gs g ON g.image_id = o.image_id AND g.gt_id = o.gt_id WHERE o.gt_id = 0 OR (g.crowd AND g.cat = d.cat) GROUP BY ALL),
 st AS (SELECT cat, sum(iou) AS s, count(*) AS tp, 0 AS fp, 0 AS fn FROM tp GROUP BY cat
  UNION ALL SELECT g.cat, 0.0E0, 0, 0, count(*) FROM gs g ANTI JOIN tp USING (image_id, gt_id) WHERE NOT crowd GROUP BY g.cat
  UNION ALL SELECT d.cat, 0.0E0, 0, count(*), 0 FROM (SELECT ds.* FROM ds ANTI JOIN tp USING (image_id, dt_id)) d LEFT JOIN cov c USING (image_id, dt_id) WHERE 2 * coalesce(c.c, 0) <= d.area GROUP BY d.cat),
 cls AS (SELECT cat, sum(s) AS s, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM st GROUP BY cat),
 pq AS (SELECT cat, s / (tp + 5.0E-1 * (fp + fn)) AS pq, CASE WHEN tp > 0 THEN s / tp ELSE 0.0E0 END AS sq, tp / (tp + 5.0E-1 * (fp + fn)) AS rq, tp, fp, fn FROM cls)"""


def panoptic_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, k = F.col("l_orderkey"), F.col("l_linenumber")
    base = F.floor(o / 5000).cast("long") * 10
    px = read(spark, sf_dir, "lineitem").select((o % 5000).cast("long").alias("image_id"), F.when(F.col("l_partkey") % 29 == 0, 0).otherwise(base + k % 2 + 1).cast("long").alias("gt_id"), F.when(F.col("l_suppkey") % 31 == 0, 0).otherwise(base + k % 3 % 2 + 1).cast("long").alias("dt_id"), F.col("l_quantity").cast("long").alias("n"))
    pairs = px.groupBy("image_id", "gt_id", "dt_id").agg(F.sum("n").alias("n"))
    g, d = F.col("segment_id"), F.col("segment_id")
    gt = pairs.where("gt_id <> 0").groupBy("image_id", F.col("gt_id").alias("segment_id")).agg(F.sum("n").alias("area")).select("image_id", "segment_id", "area", (g % 4).alias("category_id"), (g % 13 == 5).alias("iscrowd"))
    dt = pairs.where("dt_id <> 0").groupBy("image_id", F.col("dt_id").alias("segment_id")).agg(F.sum("n").alias("area")).select("image_id", "segment_id", "area", F.when(d % 7 == 3, (d + 1) % 4).otherwise(d % 4).alias("category_id"))
    return pairs, gt, dt


@query("panoptic_pq", "WITH " + _PAN_SQL + " SELECT cat AS category_id, round(pq, 9) AS pq, round(sq, 9) AS sq, round(rq, 9) AS rq, CAST(tp AS BIGINT) AS n_tp, CAST(fp AS BIGINT) AS n_fp, CAST(fn AS BIGINT) AS n_fn FROM pq")
def panoptic_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panoptic.per_class(panoptic.attribution(*panoptic_inputs(spark, sf_dir)))
    return out.select("category_id", *[F.round(c, 9).alias(c) for c in ("pq", "sq", "rq")], "n_tp", "n_fp", "n_fn")


@query("panoptic_things_stuff", "WITH " + _PAN_SQL + " SELECT label, round(avg(pq), 9) AS pq, round(avg(sq), 9) AS sq, round(avg(rq), 9) AS rq, count(*) AS n FROM (SELECT pq.*, unnest(['all', CASE WHEN cat % 2 = 0 THEN 'things' ELSE 'stuff' END]) AS label FROM pq) x GROUP BY label")
def panoptic_things_stuff(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = panoptic.per_class(panoptic.attribution(*panoptic_inputs(spark, sf_dir)))
    categories = spark.range(4).select(F.col("id").alias("category_id"), (F.col("id") % 2 == 0).alias("isthing"))
    out = panoptic.average(classes, categories)
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("pq", "sq", "rq")], "n")


# ------------------------------------------------- masks, keypoints, streams

#: Each order is a 40 x 50 mask of two bars; runs go down the columns.
_RLE_SQL = "rle AS (SELECT o_orderkey AS id, [o_custkey % 300, o_orderkey % 90 + 1, o_custkey % 200 + 5, o_orderkey % 70 + 1, 2000 - (o_custkey % 300 + o_orderkey % 90 + 1 + o_custkey % 200 + 5 + o_orderkey % 70 + 1)] AS counts FROM orders)"


def rle_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    head = [c % 300, o % 90 + 1, c % 200 + 5, o % 70 + 1]
    counts = F.array(*[x.cast("long") for x in head], (2000 - (head[0] + head[1] + head[2] + head[3])).cast("long"))
    return read(spark, sf_dir, "orders").select(o.cast("long").alias("id"), counts.alias("counts"))


@query("rle_area", "WITH " + _RLE_SQL + " SELECT id, CAST(counts[2] + counts[4] AS BIGINT) AS area FROM rle")
def rle_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rle_masks(spark, sf_dir).select("id", masks.rle_area(F.col("counts")).alias("area"))


_SPAN = "greatest(0, least({a}1, {b}1) - greatest({a}0, {b}0))"


@query("rle_intersect", "WITH " + _RLE_SQL + """,
 s AS (SELECT id, id % 1000 AS cell, counts[1] AS p0, counts[1] + counts[2] AS p1, counts[1] + counts[2] + counts[3] AS q0, counts[1] + counts[2] + counts[3] + counts[4] AS q1 FROM rle),
 x AS (SELECT a.id AS a_id, b.id AS b_id, """ + " + ".join(f"greatest(0, least(a.{u}1, b.{v}1) - greatest(a.{u}0, b.{v}0))" for u in "pq" for v in "pq") + """ AS inter, (a.p1 - a.p0 + a.q1 - a.q0) + (b.p1 - b.p0 + b.q1 - b.q0) AS total FROM s a JOIN s b ON a.cell = b.cell AND b.id = a.id + 1000)
 SELECT a_id, b_id, CAST(inter AS BIGINT) AS inter, round(inter / CAST(total - inter AS DOUBLE), 9) AS iou FROM x""")
def rle_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mask against the next of its cell."""
    rows = rle_masks(spark, sf_dir).select("id", masks.rle_area(F.col("counts")).alias("area"), masks.rle_spans(F.col("counts")).alias("spans"))
    a = rows.select(F.col("id").alias("a_id"), (F.col("id") + 1000).alias("b_id"), F.col("area").alias("a_area"), F.col("spans").alias("a_spans"))
    b = rows.select(F.col("id").alias("b_id"), F.col("area").alias("b_area"), F.col("spans").alias("b_spans"))
    both = a.join(b, "b_id").withColumn("inter", masks.rle_overlap(F.col("a_spans"), F.col("b_spans")))
    return both.select("a_id", "b_id", "inter", F.round(F.col("inter") / (F.col("a_area") + F.col("b_area") - F.col("inter")), 9).alias("iou"))


def _pose(id_: str) -> str:
    return f"list_transform(range(0, 17), lambda k: {{'x': CAST(({id_} * 7 + k * 31) % 200 AS DOUBLE), 'y': CAST(({id_} * 13 + k * 17) % 150 AS DOUBLE), 'v': ({id_} + k) % 3}})"


_SIGMAS_SQL = "[" + ", ".join(f"{s!r}E0" for s in COCO_SIGMAS) + "]"


@query("oks_pairs", f"""WITH p AS (SELECT s_suppkey AS id, {_pose('s_suppkey')} AS g, {_SIGMAS_SQL} AS sg FROM supplier),
 t AS (SELECT id, list_transform(range(1, 18), lambda k: CASE WHEN g[k].v > 0 THEN exp(-((id % 5) * (id % 5) + (k % 3) * (k % 3)) / ((sg[k] * 2) * (sg[k] * 2)) / 6.0E3 / 2) END) AS e FROM p)
 SELECT id, round(list_sum(e) / list_count(e), 9) AS oks FROM t""")
def oks_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoints made from the suppliers against shifted copies."""
    i = F.col("s_suppkey")
    k = F.sequence(F.lit(0), F.lit(16))
    flat = lambda dx, dy: F.flatten(F.transform(k, lambda j: F.array(((i * 7 + j * 31) % 200).cast("double") + dx(j), ((i * 13 + j * 17) % 150).cast("double") + dy(j), ((i + j) % 3).cast("double"))))
    rows = read(spark, sf_dir, "supplier").select(i.alias("id"), flat(lambda j: F.lit(0.0), lambda j: F.lit(0.0)).alias("g"), flat(lambda j: i % 5, lambda j: (j + 1) % 3).alias("d"))
    whole = box(F.lit(0.0), F.lit(0.0), F.lit(200.0), F.lit(150.0))
    return rows.select("id", F.round(oks(F.col("g"), F.col("d"), whole, F.lit(6000.0)), 9).alias("oks"))


@query("stream_merge_equals_batch", ORACLES["match_ladder"])
def stream_merge_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranks of images matched apart, their ``matches`` united: the same rows as in one go."""
    gt, dt = inputs(spark, sf_dir)
    parts = None
    for rank in range(3):
        here = F.col("image_id") % 3 == rank
        part = matching.match(gt.where(here), matching.top_k(dt.where(here), PARAMS.max_dets[-1]), PARAMS)
        parts = part if parts is None else parts.unionByName(part)
    rows = match_rows(parts)
    return rows.groupBy("area_idx", "t_idx", "category_id").agg(F.count("*").alias("n"), F.count_if("matched").alias("n_matched"), F.count_if("ignored").alias("n_ignored"), F.coalesce(F.sum("ann_id"), F.lit(0)).cast("long").alias("ann_sum"))


@query("semantic_classes", _CONF_SQL + """,
 c AS (SELECT k, (SELECT sum(n) FROM conf WHERE g = k) AS gt, (SELECT sum(n) FROM conf WHERE d = k) AS dt, (SELECT sum(n) FROM conf WHERE g = k AND d = k) AS hit FROM range(0, 7) r(k))
 SELECT CAST(k AS INTEGER) AS class_id, CAST(gt AS BIGINT) AS n_gt, CAST(dt AS BIGINT) AS n_dt, CAST(hit AS BIGINT) AS n_hit, round(hit / CAST(gt + dt - hit AS DOUBLE), 9) AS iou, round(hit / CAST(gt AS DOUBLE), 9) AS recall, round(hit / CAST(dt AS DOUBLE), 9) AS precision FROM c""")
def semantic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = semantic.per_class(semantic.confusion(pixel_runs(spark, sf_dir), 7, 255), 7)
    return out.select("class_id", "n_gt", "n_dt", "n_hit", *[F.round(c, 9).alias(c) for c in ("iou", "recall", "precision")])


@query(
    "ground_truth_hash",
    _base() + " SELECT category_id, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(concat_ws('/', CAST(ann_id AS VARCHAR), CAST(image_id AS VARCHAR), CAST(CAST(round(area * 4) AS BIGINT) AS VARCHAR), CASE WHEN iscrowd THEN '1' ELSE '0' END)), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM gt GROUP BY category_id",
)
def ground_truth_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-free identity of the ground truth by category: a count and the sum of pieces of row hashes."""
    gt = ground_truth(spark, sf_dir)
    line = F.sha2(F.concat_ws("/", F.col("ann_id").cast("string"), F.col("image_id").cast("string"), F.round(F.col("area") * 4).cast("long").cast("string"), F.col("iscrowd").cast("int").cast("string")), 256)
    piece = F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(20,0)")
    return gt.groupBy("category_id").agg(F.count("*").alias("n"), F.sum(piece).cast("string").alias("digest"))


# ------------------------------------------------------------------- ingest

_INGEST_SQL = _base() + " SELECT image_id, category_id, x, y, w, h, area, score FROM dt"


def _ingested(rows: DataFrame) -> DataFrame:
    return coco.detections(rows).select("image_id", "category_id", "bbox.*", "area", "score")


def _by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's detections as arrays, boxes by their corners."""
    b = F.col("bbox")
    corners = F.array(b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"])
    own = detections(ground_truth(spark, sf_dir)).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("dt_id", corners.alias("b"), "score", "category_id"))).alias("x"))
    return own.select("image_id", F.col("x.b").alias("boxes"), F.col("x.score").alias("scores"), F.col("x.category_id").alias("labels"))


@query("ingest_per_image", _INGEST_SQL)
def ingest_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(ingest.per_image(_by_image(spark, sf_dir), "xyxy"))


@query("ingest_batch", _INGEST_SQL)
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every hundred images, with their counts."""
    images = _by_image(spark, sf_dir).withColumn("counts", F.size("boxes").cast("long"))
    one = images.groupBy(F.floor(F.col("image_id") / 100)).agg(F.array_sort(F.collect_list(F.struct("image_id", "counts", "boxes", "scores", "labels"))).alias("x"))
    return _ingested(ingest.batch(one.select(F.col("x.image_id").alias("image_ids"), F.col("x.counts").alias("counts"), *[F.flatten(F.col(f"x.{c}")).alias(c) for c in ("boxes", "scores", "labels")]), "xyxy"))


@query("ingest_matrix", _INGEST_SQL)
def ingest_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    dt = detections(ground_truth(spark, sf_dir))
    return _ingested(ingest.matrix(dt.select(F.col("image_id").cast("double"), "bbox.*", "score", F.col("category_id").cast("double"))))


@query("ingest_json", _INGEST_SQL)
def ingest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the text of result records."""
    b = F.col("bbox")
    text = detections(ground_truth(spark, sf_dir)).select(F.to_json(F.struct("image_id", "category_id", "score", F.array(*[b[k] for k in "xywh"]).alias("bbox"))).alias("t"))
    return _ingested(text.select(F.from_json("t", coco.DETECTION).alias("x")).select("x.*"))
