"""Greedy matching of detections to ground truth, cell by cell.

A cell is an image and a category. One Arrow pass over flat rows, many whole cells at once, finds the
pairs of boxes by array arithmetic and settles detections level by level: those that compete for no
ground truth pick together, for all thresholds. Pairs of other similarities come from an equi-join on
the cell; below the least threshold they are dropped inside it.

The result, ``matches``, has a row per detection that is within the cap:
``image_id, category_id, dt_id, score, area, rank`` and, by area range, ``matched`` and ``ignored``
(a bit per threshold) and ``gts`` (a matched ann_id per threshold, or null). Everything to its right
is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelyard.functions.geometry import box_iou, met_iou, overlapping
from pixelyard.operators import pairing
from pixelyard.plans.params import Params
from pixelyard.workers import ship

CELL = ["image_id", "category_id"]
#: What a similarity may look at, where both sides have it.
SHAPES = ("bbox", "keypoints", "mask", "band", "tight")
MATCHES = "image_id long, category_id long, dt_id long, score double, area double, rank int, matched array<long>, ignored array<long>, gts array<array<long>>"


def top_k(dt: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The ``k`` best rows by score in each of ``by`` (input order breaks ties), with their ``rank`` from 1 on."""
    w = Window.partitionBy(*(by or CELL)).orderBy(F.desc("score"), F.asc("ord"))
    return dt.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def effective_ignore(gt: DataFrame, mode: str, keypoints: bool = False) -> DataFrame:
    """Add ``ign``: crowds; in corrected mode the row's own ``ignore`` decides where it is set."""
    ign = F.coalesce("iscrowd", F.lit(False))
    if mode == "corrected":
        ign = F.coalesce("ignore", ign)
    if keypoints:
        ign = ign | (F.coalesce("num_keypoints", F.lit(0)) == 0)
    return gt.withColumn("ign", ign)


def collapse_categories(df: DataFrame, use_cats: bool) -> DataFrame:
    return df if use_cats else df.withColumn("category_id", F.lit(-1).cast("long"))


def ground_truth_counts(gt: DataFrame, params: Params) -> DataFrame:
    """``category_id, area_idx, npig``: rows of ``gt`` (with ``ign``) that count, by area range."""
    ranges = F.array(*[F.struct(F.lit(i).alias("area_idx"), F.lit(a.lo).alias("lo"), F.lit(a.hi).alias("hi")) for i, a in enumerate(params.areas)])
    spread = gt.select("category_id", "area", "ign", F.explode(ranges).alias("r"))
    counts = ~F.col("ign") & F.col("area").between(F.col("r.lo"), F.col("r.hi"))
    return spread.groupBy("category_id", F.col("r.area_idx").alias("area_idx")).agg(F.count_if(counts).alias("npig"))


def greedy(edges: list[list[tuple]], seeds: tuple[float, ...], ignored: Callable[[tuple], bool]) -> list[list[tuple | None]]:
    """For each threshold, the edge that each detection takes.

    ``edges``: for each detection in order of rank its candidates ``(ord, ann_id, area, ign, crowd, iou)``.
    Candidates that count come before ignored ones, by ``ord`` within each; a later candidate wins a
    tie; an ignored one is taken only if none that counts is; only a crowd is taken twice.
    """
    flags = [[(ignored(e), e) for e in own] for own in edges]
    for own in flags:
        own.sort(key=lambda x: (x[0], x[1][0]))
    out = []
    for seed in seeds:
        taken: set[int] = set()
        found: list[tuple | None] = []
        for own in flags:
            best, pick, pick_ign = seed, None, False
            for ign, e in own:
                if e[1] in taken and not e[4]:
                    continue
                if pick is not None and ign and not pick_ign:
                    break
                if e[5] < best:
                    continue
                best, pick, pick_ign = e[5], e, ign
            if pick is not None:
                taken.add(pick[1])
            found.append(pick)
        out.append(found)
    return out


def bbox_similarity(g: Column, d: Column) -> Column:
    """Of the struct columns of both sides."""
    return box_iou(g["bbox"], d["bbox"], g["iscrowd"])


bbox_similarity.met = lambda g, d: met_iou(g["bbox"], d["bbox"], g["iscrowd"])  # once their boxes overlap


def scored_pairs(gt: DataFrame, dt: DataFrame, least: float, similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``image_id, category_id, rank, dt_id, edge`` of every pair of a cell at ``least`` or more.

    The pairs stay inside the join and the filter above it; only those that are left are gathered later.
    """
    shapes = [c for c in SHAPES if c in gt.columns and c in dt.columns]
    g = gt.select(*CELL, F.struct("ord", "ann_id", "category_id", "area", "ign", F.coalesce("iscrowd", F.lit(False)).alias("iscrowd"), *shapes).alias("g"))
    d = dt.select(*CELL, "rank", "dt_id", F.struct("area", *shapes).alias("d"))
    met, score = d.join(g, CELL), similarity or bbox_similarity
    if least > 0 and not getattr(score, "anywhere", False):  # box and mask kernels: most pairs end here
        shape = "tight" if "tight" in shapes else "bbox"
        met = met.where(overlapping(F.col("g")[shape], F.col("d")[shape]))
        score = getattr(score, "met", score)
    near = met.withColumn("iou", score(F.col("g"), F.col("d"))).where(F.col("iou") >= least)
    edge = F.struct(F.col("g.ord").alias("g_ord"), F.col("g.ann_id").alias("ann_id"), F.col("g.area").alias("g_area"), F.col("g.ign").alias("ign"), F.col("g.iscrowd").alias("crowd"), "iou")
    return near.select(*CELL, "rank", "dt_id", edge.alias("edge"))


def cells(gt: DataFrame, dt: DataFrame, least: float, similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """A row a cell with detections: ``dts`` in order of rank, and ``edges`` with the ranks they belong to (null without any)."""
    dts = dt.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("rank", "dt_id", "score", "area"))).alias("dts"))
    edges = scored_pairs(gt, dt, least, similarity).groupBy(*CELL).agg(F.collect_list(F.struct("rank", "edge")).alias("edges"))
    return dts.join(edges, CELL, "left")


def edges_by_place(dts: list[dict], edges: list[dict] | None) -> list[list[tuple]]:
    """For each of ``dts`` its candidates ``(ord, ann_id, area, ign, crowd, iou)``."""
    out: list[list[tuple]] = [[] for _ in dts]
    if edges:
        place = {d["rank"]: i for i, d in enumerate(dts)}
        for x in edges:
            e = x["edge"]
            out[place[x["rank"]]].append((e["g_ord"], e["ann_id"], e["g_area"], e["ign"], e["crowd"], e["iou"]))
    return out


_FLAT = ["image_id", "category_id", "rank", "dt_id", "score", "area", "open", "g_ord", "ann_id", "g_area", "ign", "crowd", "iou"]
SIDES = ("x", "y", "w", "h")


def plain_boxes(least: float, similarity: Callable | None) -> bool:
    """Whether the similarity is that of boxes, at a threshold that only overlapping ones reach."""
    return least > 0 and (similarity is None or similarity is bbox_similarity)


def candidates(gt: DataFrame, dt: DataFrame, least: float, similarity: Callable | None = None) -> DataFrame:
    """Rows of ``dt`` and, by their ``ann_id``, of what may match them, numbered within the cell by ``place``.

    For boxes these are the cell's rows of ``gt``, whose pairs the Arrow pass finds; other similarities
    give a row a pair at ``least`` or more, with its ``rank`` and ``iou``. The numbers also keep every
    cell in one partition, row next to row.
    """
    is_open = F.coalesce("open", F.lit(False)) if "open" in dt.columns else F.lit(False)
    own = dt.select(*CELL, "rank", "dt_id", "score", "area", is_open.alias("open"), *([F.col("bbox")[c].alias(c) for c in SIDES] if plain_boxes(least, similarity) else []))
    if plain_boxes(least, similarity):
        crowd = F.coalesce("iscrowd", F.lit(False)).alias("crowd")
        other = gt.select(*CELL, F.col("ord").alias("g_ord"), "ann_id", F.col("area").alias("g_area"), "ign", crowd, *[F.col("bbox")[c].alias(c) for c in SIDES])
    else:
        other = scored_pairs(gt, dt, least, similarity).select(*CELL, "rank", "dt_id", "edge.*")
    known = F.col("image_id").isNotNull() & F.col("category_id").isNotNull() & F.col("ann_id").isNotNull()  # nulls match nothing
    rows = own.unionByName(other.where(known), allowMissingColumns=True)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*CELL).orderBy("rank")))


def _edges(x: dict[str, np.ndarray], d: dict[str, np.ndarray], cell: np.ndarray, d_cell: np.ndarray, least: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The candidates of the detections ``d``, and the place of each one's detection in ``d``."""
    e = {c: v[x["has"]] for c, v in x.items()}
    if "x" in x:
        det, at, iou, _ = pairing.meeting(d_cell, tuple(d[c] for c in SIDES), cell[x["has"]], tuple(e[c] for c in SIDES), e["crowd"], least)
        return {c: e[c][at] for c in ("g_ord", "ann_id", "g_area", "ign", "crowd")} | {"iou": iou}, det
    ranks = int(x["rank"].max(initial=0)) + 1
    return e, np.searchsorted(d_cell * ranks + d["rank"], cell[x["has"]] * ranks + e["rank"])


def _settle(batch: pa.RecordBatch, seeds: tuple[float, ...], areas: list[tuple[float, float]]) -> pa.RecordBatch:
    """``matches`` of the rows of whole cells."""
    x = _arrays(batch)
    n_t, n_a, full = len(seeds), len(areas), (1 << len(seeds)) - 1
    cell = pairing.numbered(x, CELL)
    heads = np.flatnonzero(~x["has"])
    heads = heads[np.lexsort((x["rank"][heads], cell[heads]))]
    d, d_cell = {c: v[heads] for c, v in x.items()}, cell[heads]
    e, det = _edges(x, d, cell, d_cell, min(seeds))
    codes = np.unique(e["ann_id"], return_inverse=True)[1]
    gt = np.unique(d_cell[det] * (len(codes) + 1) + codes, return_inverse=True)[1]
    picks = pairing.Picks(len(heads), det, gt, e["g_ord"], e["crowd"], e["iou"])
    lo, hi = np.array(areas).T
    out_of = lambda size: ~((size[:, None] >= lo) & (size[:, None] <= hi))  # noqa: E731  a null or NaN size is in no range

    off, outside, bits = e["ign"][:, None] | out_of(e["g_area"]), out_of(d["area"]) | d["open"][:, None], np.int64(1) << np.arange(n_t)
    hits, igns = np.zeros((len(heads), n_a), dtype=np.int64), np.zeros((len(heads), n_a), dtype=np.int64)
    ids, known = np.zeros((len(heads), n_a, n_t), dtype=np.int64), np.zeros((len(heads), n_a, n_t), dtype=bool)
    for a in range(n_a):
        edge = picks.of(np.array(seeds), off[:, a])
        known[:, a] = edge >= 0
        hits[:, a] = known[:, a] @ bits
        if len(det):
            igns[:, a] = (known[:, a] & off[edge, a]) @ bits
            ids[:, a] = e["ann_id"][edge]
    igns |= np.where(outside, full & ~hits, 0)
    some = hits.ravel() > 0
    ends = np.append(0, np.cumsum(some * n_t)).astype(np.int32)
    inner = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~some, False)), pa.array(ids.reshape(-1, n_t)[some].ravel(), mask=~known.reshape(-1, n_t)[some].ravel()))
    by_area = pa.array(np.arange(0, len(heads) * n_a + 1, n_a, dtype=np.int32))
    lists = [pa.ListArray.from_arrays(by_area, c) for c in (pa.array(hits.ravel()), pa.array(igns.ravel()), inner)]
    names = ["image_id", "category_id", "dt_id", "score", "area", "rank"]
    plain = batch.select(names).take(pa.array(heads)).columns
    return pa.RecordBatch.from_arrays([*plain, *lists], names=[*names, "matched", "ignored", "gts"])


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns as numpy arrays; ``has`` tells rows with an ``ann_id``, whose columns are 0 or NaN elsewhere."""
    return pairing.arrays(batch) | {"has": batch["ann_id"].is_valid().to_numpy(zero_copy_only=False)}


def match(gt: DataFrame, dt: DataFrame, params: Params, similarity: Callable | None = None, exhaustive: DataFrame | None = None) -> DataFrame:
    """``matches`` of ``dt`` (with ``rank``) against ``gt`` (with ``ign``).

    ``exhaustive``: cells ``(image_id, category_id)`` whose unmatched detections don't count.
    """
    ship(gt.sparkSession)
    seeds, areas = params.seeds, [(a.lo, a.hi) for a in params.areas]
    if exhaustive is not None:
        dt = dt.join(exhaustive.select(*CELL).distinct().withColumn("open", F.lit(True)), CELL, "left")
    rows = candidates(gt, dt, min(seeds), similarity)
    at_once = min(pairing.CHUNK_ROWS, pairing.CHUNK_ROWS * 40 // (len(seeds) * len(areas)))

    def run(batches):
        for batch in pairing.whole_cells(batches, at_once):
            yield _settle(batch, seeds, areas)

    return rows.mapInArrow(run, MATCHES)


def pairs(gt: DataFrame, dt: DataFrame, floor: float = 0.1, similarity: Callable | None = None) -> DataFrame:
    """``image_id, category_id, dt_id, ann_id, iou`` of every pair of a cell at ``floor`` or more."""
    rows = scored_pairs(gt, dt, floor, similarity)
    return rows.select(*CELL, "dt_id", F.col("edge.ann_id").alias("ann_id"), F.col("edge.iou").alias("iou"))
