"""Precision and recall from ``matches``.

Rows are sorted by score once per category. One Arrow pass keeps the running counts of all thresholds,
area ranges and caps at once, a batch at a time. A true positive's recall says up to which recall
threshold its precision counts, so what leaves the pass is the best precision by recall threshold, at
most a row each, and the envelope is a running maximum over those. A category of more rows than one
task should sort is dealt by score ranges instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelyard.functions.numeric import EPS, RECALL_LADDER
from pixelyard.plans.params import Params
from pixelyard.workers import ship

LANE = ["category_id", "area_idx", "m_idx", "t_idx"]
#: Rows of one category, area range and cap that one task still sorts; larger ones are split by score.
SPLIT_ROWS = 5_000_000


def lanes(matches: DataFrame, params: Params, extra: list[str] | None = None) -> DataFrame:
    """A row per detection, area range and cap, with its bits ``hit`` and ``ign``."""
    caps = F.array(*[F.struct(F.lit(i).alias("m_idx"), F.lit(m).alias("cap")) for i, m in enumerate(params.max_dets)])
    by_area = matches.select(*(extra or []), "category_id", "image_id", "rank", "score", F.posexplode(F.arrays_zip("matched", "ignored")).alias("area_idx", "x"))
    spread = by_area.select(*(extra or []), "category_id", "image_id", "rank", "score", "area_idx", F.col("x.matched").alias("hit"), F.col("x.ignored").alias("ign"), F.explode(caps).alias("m"))
    return spread.where(F.col("rank") <= F.col("m.cap")).withColumn("m_idx", F.col("m.m_idx")).drop("m")


def _bit(bits: Column, t: int) -> Column:
    return F.shiftright(bits, t).bitwiseAND(F.lit(1))


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], split: bool | None = None) -> DataFrame:
    """Add running sums over ``order`` within ``keys``.

    A key of more than ``SPLIT_ROWS`` rows isn't sorted by one task: rows are then dealt by ranges of
    (keys, order), summed within each range, and the totals of the ranges before are added. These are
    as many rows as ranges and keys together.
    """
    if split is None:
        split = bool(rows.groupBy(*keys).count().where(F.col("count") > SPLIT_ROWS).take(1))
    if not split:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    named = rows.select("*", *[c.alias(f"_{k}") for k, c in sums.items()])
    dealt = named.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    w = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part", *keys).agg(*[F.sum(f"_{k}").alias(f"_t{k}") for k in sums])
    offsets = totals.select("_part", *keys, *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_o{k}") for k in sums])
    inner = dealt.select("*", *[F.sum(f"_{k}").over(w).alias(f"_w{k}") for k in sums])
    out = inner.join(offsets, ["_part", *keys])
    return out.select(*rows.columns, *[(F.col(f"_w{k}") + F.col(f"_o{k}")).alias(k) for k in sums])


def _reached(rc: Column, thresholds: tuple[float, ...]) -> Column:
    """The last index whose threshold is at most ``rc``; -1 if none is."""
    array = F.array(*[F.lit(float(r)) for r in thresholds])
    if thresholds == RECALL_LADDER:
        near = F.least(F.lit(100), F.floor(rc * 100).cast("int") + 1)
        down = F.when(F.element_at(array, near + 1) > rc, near - 1).otherwise(near)
        return F.when(F.element_at(array, down + 1) > rc, down - 1).otherwise(down)
    return F.size(F.filter(array, lambda r: r <= rc)) - 1


def true_positives(matches: DataFrame, params: Params, extra: list[str] | None = None, split: bool | None = None) -> DataFrame:
    """A row per true positive of each lane: its score and the counts ``tp`` and ``fp`` up to it."""
    extra = extra or []
    n = len(params.iou_thresholds)
    rows = lanes(matches, params, extra)
    sums = {f"tp_{t}": _bit(F.col("hit").bitwiseAND(F.bitwise_not("ign")), t) for t in range(n)} | {f"fp_{t}": _bit(F.bitwise_not(F.col("hit").bitwiseOR(F.col("ign"))), t) for t in range(n)}
    keys = [*extra, "category_id", "area_idx", "m_idx"]
    counted = running(rows, keys, [F.desc("score"), F.asc("image_id"), F.asc("rank")], sums, split)
    per_t = F.array(*[F.when(_bit(F.col("hit").bitwiseAND(F.bitwise_not("ign")), t) == 1, F.struct(F.lit(t).alias("t_idx"), F.col(f"tp_{t}").alias("tp"), F.col(f"fp_{t}").alias("fp"))) for t in range(n)])
    return counted.select(*keys, "score", F.explode(F.array_compact(per_t)).alias("x")).select(*keys, "x.t_idx", "score", "x.tp", "x.fp")


class _Counts:
    """One key's running counts over its rows in score order, and the best of each recall index (moved up by one)."""

    def __init__(self, npig: np.ndarray, params: Params):
        self.npig, self.params = npig, params
        self.caps, self.recalls = np.array(params.max_dets), np.array(params.recall_thresholds)
        lanes = (len(npig), len(self.caps), len(params.iou_thresholds))
        self.tp, self.fp = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        size = int(np.prod(lanes)) * (len(self.recalls) + 1)
        self.precision, self.score, self.most = np.full(size, -1.0), np.zeros(size), np.zeros(size, dtype=np.int64)

    def add(self, rank: np.ndarray, score: np.ndarray, hit: np.ndarray, ign: np.ndarray) -> None:
        bits = np.arange(len(self.params.iou_thresholds))
        on = lambda x: ((x[:, :, None] >> bits) & 1).astype(bool)  # noqa: E731  row, area, threshold
        is_tp, is_fp = on(hit & ~ign), on(~(hit | ign))
        for a in np.flatnonzero(self.npig > 0).tolist():
            for m, cap in enumerate(self.caps.tolist()):
                inside = (rank <= cap)[:, None]
                hits = is_tp[:, a] & inside
                tp = np.cumsum(hits, axis=0) + self.tp[a, m]
                fp = np.cumsum(is_fp[:, a] & inside, axis=0) + self.fp[a, m]
                self.tp[a, m], self.fp[a, m] = tp[-1], fp[-1]
                row, t = np.nonzero(hits)
                if len(row):
                    upto = tp[row, t]
                    b = np.searchsorted(self.recalls, upto / self.npig[a], side="right")
                    at = ((a * len(self.caps) + m) * len(bits) + t) * (len(self.recalls) + 1) + b
                    np.maximum.at(self.precision, at, upto / ((upto + fp[row, t]) + EPS))
                    np.maximum.at(self.score, at, score[row])
                    np.maximum.at(self.most, at, upto)

    def rows(self) -> list[np.ndarray]:
        """Columns ``area_idx, m_idx, t_idx, npig, b, p, s, tp``."""
        at = np.flatnonzero(self.precision >= 0)
        lane, b = np.divmod(at, len(self.recalls) + 1)
        lane, t = np.divmod(lane, len(self.params.iou_thresholds))
        a, m = np.divmod(lane, len(self.caps))
        return [*(x.astype(np.int32) for x in (a, m, t)), self.npig[a], (b - 1).astype(np.int32), self.precision[at], self.score[at], self.most[at]]


def _counted(matches: DataFrame, npig: DataFrame, params: Params, keys: list[str]) -> DataFrame:
    """Each lane's best precision and score, and its true positives, by the last recall threshold reached."""
    n_a = len(params.areas)
    by_area = F.map_from_entries(F.collect_list(F.struct("area_idx", "npig")))
    known = npig.where("npig > 0").groupBy(*keys).agg(by_area.alias("x")).select(*keys, F.array(*[F.coalesce(F.element_at("x", F.lit(a)), F.lit(0)).cast("long") for a in range(n_a)]).alias("npigs"))
    rows = matches.select(*keys, "image_id", "rank", "score", "matched", "ignored").join(known, keys)
    # the window keeps a key's rows in one task, in order: a repartition after the join could be left out and the join's skewed parts split
    ordered = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "image_id", "rank")))
    fields = [T.StructField(n, k) for n, k in (("area_idx", T.IntegerType()), ("m_idx", T.IntegerType()), ("t_idx", T.IntegerType()), ("npig", T.LongType()), ("b", T.IntegerType()), ("p", T.DoubleType()), ("s", T.DoubleType()), ("tp", T.LongType()))]
    schema = T.StructType([*(rows.schema[k] for k in keys), *fields])
    ship(matches.sparkSession)

    def run(batches):
        key, counts, upto = None, None, 0

        def finished():
            columns = counts.rows()
            return pa.RecordBatch.from_arrays([*(pa.repeat(k, len(columns[0])) for k in key), *map(pa.array, columns)], names=schema.names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            changes = np.zeros(n, dtype=bool)
            for k in keys:
                codes = batch[k].dictionary_encode(null_encoding="encode").indices.to_numpy()
                changes[1:] |= codes[1:] != codes[:-1]
            flat = lambda c: c.flatten().to_numpy().reshape(-1, n_a)
            place = batch["place"].to_numpy()
            rank, score, hit, ign = batch["rank"].to_numpy(), batch["score"].to_numpy(), flat(batch["matched"]), flat(batch["ignored"])
            starts = [0, *np.flatnonzero(changes).tolist(), n]
            for i, j in zip(starts, starts[1:]):
                own = [batch[k][i] for k in keys]
                if own != key:
                    if key is not None:
                        yield finished()
                    key, counts, upto = own, _Counts(np.array(batch["npigs"][i].as_py()), params), 0
                if place[i] != upto + 1 or place[j - 1] != upto + j - i:
                    raise RuntimeError("a key's rows aren't together")
                upto += j - i
                counts.add(rank[i:j], score[i:j], hit[i:j], ign[i:j])
        if key is not None:
            yield finished()

    return ordered.mapInArrow(run, schema)


def steps(matches: DataFrame, npig: DataFrame, params: Params, extra: list[str] | None = None, split: bool | None = None) -> DataFrame:
    """Each lane's precision as steps: ``precision`` and ``score`` hold for the recall indices over ``next`` up to ``b``; ``tp`` true positives reach ``b``."""
    extra = extra or []
    lane, keys = [*extra, *LANE], [*extra, "category_id"]
    if split is None:
        matches = matches.select(*keys, "image_id", "rank", "score", "matched", "ignored").persist()  # the largest key is counted first
        split = bool(matches.groupBy(*keys).count().where(F.col("count") > SPLIT_ROWS).take(1))
    if split:
        known = npig.where(F.col("npig") > 0).select(*extra, "category_id", "area_idx", "npig")
        tps = true_positives(matches, params, extra, split).join(known, [*extra, "category_id", "area_idx"])
        tps = tps.withColumn("b", _reached(F.col("tp") / F.col("npig"), params.recall_thresholds)).withColumn("precision", F.col("tp") / ((F.col("tp") + F.col("fp")) + F.lit(EPS)))
        best = tps.groupBy(*lane, "npig", "b").agg(F.max("precision").alias("p"), F.max("score").alias("s"), F.max("tp").alias("tp"))
    else:
        best = _counted(matches, npig, params, keys)
    down = Window.partitionBy(*lane).orderBy(F.desc("b"))
    return best.select(*lane, "npig", "b", "tp", F.max("p").over(down).alias("precision"), F.max("s").over(down).alias("score"), F.coalesce(F.lead("b").over(down), F.lit(-1)).alias("next"))


def curve(matches: DataFrame, npig: DataFrame, params: Params, extra: list[str] | None = None, split: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Sparse ``pr(.., r_idx, precision, score)`` and ``rec(.., recall)``, per lane.

    A recall threshold that a lane's curve doesn't reach has no row in ``pr``: its precision is 0. A lane
    without true positives has no row in ``rec``: its recall is 0. Lanes without ground truth that
    counts have neither, and no value.
    """
    lane = [*(extra or []), *LANE]
    found = steps(matches, npig, params, extra, split)
    pr = found.where(F.col("b") > F.col("next")).select(*lane, F.explode(F.sequence(F.col("next") + 1, F.col("b"))).alias("r_idx"), "precision", "score")
    return pr, found.groupBy(*lane).agg((F.max("tp") / F.first("npig")).alias("recall"))


def lane_values(matches: DataFrame, npig: DataFrame, params: Params, extra: list[str] | None = None, split: bool | None = None) -> DataFrame:
    """``category_id, area_idx, m_idx, t_idx, ap, ar`` of every lane with ground truth that counts."""
    extra = extra or []
    lane = [*extra, *LANE]
    grid = F.array(*[F.struct(F.lit(m).alias("m_idx"), F.lit(t).alias("t_idx")) for m in range(len(params.max_dets)) for t in range(len(params.iou_thresholds))])
    every = npig.where(F.col("npig") > 0).select(*extra, "category_id", "area_idx", F.explode(grid).alias("x")).select(*extra, "category_id", "area_idx", "x.*")
    area = F.sum(F.col("precision") * (F.col("b") - F.col("next"))) / len(params.recall_thresholds)
    found = steps(matches, npig, params, extra, split).groupBy(*lane).agg(area.alias("ap"), (F.max("tp") / F.first("npig")).alias("ar"))
    return every.join(found, lane, "left").select(*lane, F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("ar", F.lit(0.0)).alias("ar"))


def dense(pr: DataFrame, npig: DataFrame, params: Params) -> DataFrame:
    """The full precision cube as rows: 0 past a curve's end, null without ground truth."""
    grid = F.array(*[F.struct(F.lit(m).alias("m_idx"), F.lit(t).alias("t_idx")) for m in range(len(params.max_dets)) for t in range(len(params.iou_thresholds))])
    every = npig.select("category_id", "area_idx", "npig", F.explode(grid).alias("x")).select("category_id", "area_idx", "npig", "x.*", F.explode(F.sequence(F.lit(0), F.lit(len(params.recall_thresholds) - 1))).alias("r_idx"))
    value = F.when(F.col("npig") > 0, F.coalesce("precision", F.lit(0.0)))
    return every.join(pr, [*LANE, "r_idx"], "left").select(*LANE, "r_idx", value.alias("precision"), F.when(F.col("npig") > 0, F.coalesce("score", F.lit(0.0))).alias("score"))
