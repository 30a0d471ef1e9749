"""Box matching by array arithmetic, against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelyard.functions.geometry import box
from pixelyard.operators import diagnostics, matching, pairing
from pixelyard.plans.params import Params


def iou(g, d, crowd):
    w, h = min(g[0] + g[2], d[0] + d[2]) - max(g[0], d[0]), min(g[1] + g[3], d[1] + d[3]) - max(g[1], d[1])
    inter = w * h if w > 0 and h > 0 else 0.0
    under = d[2] * d[3] if crowd else g[2] * g[3] + d[2] * d[3] - inter
    return inter / under if under > 0 else 0.0


def crowded(rng, cells, n_gt, n_dt):
    some = lambda: (float(rng.randrange(60)), float(rng.randrange(60)), float(rng.randrange(0, 30)), float(rng.randrange(1, 30)))
    gts = [(i, i % cells, some(), rng.random() < 0.1, rng.random() < 0.1) for i in range(n_gt)]
    dets = [(i, i % cells, some(), rng.choice((0.25, 0.5, 0.75))) for i in range(n_dt)]
    return gts, dets


@pytest.mark.parametrize("block", [1, 64, 1 << 20])
def test_pairs_and_picks_equal_plain_loops(monkeypatch, block):
    monkeypatch.setattr(pairing, "BLOCK_PAIRS", block)
    gts, dets = crowded(random.Random(block), 5, 200, 150)
    dets.sort(key=lambda d: (d[1], -d[3], d[0]))
    column = lambda rows, k: np.array([r[k] for r in rows])
    sides = lambda rows: tuple(np.array([r[2] for r in rows]).T)
    crowd, ign = column(gts, 3), column(gts, 4)
    det, gt, got, _ = pairing.meeting(column(dets, 1), sides(dets), column(gts, 1), sides(gts), crowd, 0.05)
    want = {(i, j): v for i, d in enumerate(dets) for j, g in enumerate(gts) if d[1] == g[1] and (v := iou(g[2], d[2], g[3])) >= 0.05}
    assert dict(zip(zip(det.tolist(), gt.tolist()), got.tolist())) == want and len(det) == len(want)
    seeds = (0.05, 0.3, 0.5)
    picks = pairing.Picks(len(dets), det, gt, gt, crowd[gt], got).of(np.array(seeds), ign[gt])
    edges = [[(j, j, 0.0, bool(ign[j]), bool(crowd[j]), want[i, j]) for j in range(len(gts)) if (i, j) in want] for i in range(len(dets))]
    for t, plain in enumerate(matching.greedy(edges, seeds, lambda e: e[3])):
        assert [None if e < 0 else int(gt[e]) for e in picks[:, t]] == [None if p is None else p[1] for p in plain]


def test_odd_boxes_meet_nothing():
    nan = float("nan")
    sides = lambda *boxes: tuple(np.array(boxes).T)
    crowd = np.array([True, False])
    det, gt, _, _ = pairing.meeting(np.zeros(3, int), sides((0.0, 0.0, nan, 5.0), (2.0, 2.0, 0.0, 3.0), (1.0, 1.0, 2.0, 2.0)), np.zeros(2, int), sides((0.0, 0.0, 9.0, 9.0), (nan, 0.0, 9.0, 9.0)), crowd, 0.1)
    assert (det.tolist(), gt.tolist()) == ([2], [0])
    empty = np.zeros(0)
    assert [len(c) for c in pairing.meeting(empty.astype(int), (empty,) * 4, np.zeros(2, int), sides((0.0, 0.0, 9.0, 9.0), (0.0, 0.0, 9.0, 9.0)), crowd, 0.1)] == [0] * 4


def frames(spark, gts, dets):
    b = box(F.col("b")[0], F.col("b")[1], F.col("b")[2], F.col("b")[3]).alias("bbox")
    gt = spark.createDataFrame([(i, c, 1, list(x), crowd, ign) for i, c, x, crowd, ign in gts], "ann_id long, image_id long, category_id long, b array<double>, iscrowd boolean, ign boolean")
    dt = spark.createDataFrame([(i, c, 1, list(x), s) for i, c, x, s in dets], "dt_id long, image_id long, category_id long, b array<double>, score double")
    return gt.select("ann_id", "image_id", "category_id", b, F.lit(100.0).alias("area"), "iscrowd", "ign", F.col("ann_id").alias("ord")), dt.select("dt_id", "image_id", "category_id", b, F.lit(100.0).alias("area"), "score", F.col("dt_id").alias("ord"))


def test_boxes_are_matched_without_a_join(spark):
    """A join's condition on every pair of large cells was what took the time; a thin box in a crowd divided by zero there."""
    params = Params(iou_thresholds=(0.5,), areas=Params().areas[:1])
    gts, dets = crowded(random.Random(1), 3, 240, 240)
    gts.append((900, 7, (0.0, 0.0, 50.0, 50.0), True, True))  # a cell without detections, and one with a thin one
    gts.append((901, 8, (0.0, 0.0, 50.0, 50.0), True, True))
    dets += [(901, 8, (5.0, 5.0, 0.0, 9.0), 0.5), (902, 9, (5.0, 5.0, 9.0, 9.0), 0.5)]
    gt, dt = frames(spark, gts, dets)
    out = matching.match(gt, matching.top_k(dt, 100), params)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["dt_id"]: (r["gts"][0] or [None])[0] for r in out.collect()}
    assert len(got) == len(dets)
    for c in {d[1] for d in dets}:
        own = sorted((d for d in dets if d[1] == c), key=lambda d: (-d[3], d[0]))
        edges = [[(g[0], g[0], 0.0, g[4], g[3], v) for g in gts if g[1] == c and (v := iou(g[2], d[2], g[3])) >= 0.5] for d in own]
        (plain,) = matching.greedy(edges, (0.5,), lambda e: e[3])
        assert [got[d[0]] for d in own] == [None if p is None else p[1] for p in plain]


def test_nulls_match_nothing(spark):
    gt, dt = frames(spark, [(1, None, (0.0, 0.0, 9.0, 9.0), False, False), (2, 0, (0.0, 0.0, 9.0, 9.0), False, False)], [(1, None, (0.0, 0.0, 9.0, 9.0), 0.9), (2, 0, (0.0, 0.0, 9.0, 9.0), 0.9)])
    rows = {r["dt_id"]: r for r in matching.match(gt, matching.top_k(dt, 100), Params()).collect()}
    assert rows[1]["image_id"] is None and rows[1]["matched"][0] == 0 and rows[2]["matched"][0] == 1023


def test_error_types_are_told_apart_without_a_join(spark):
    """Every pair of an image went through a join's condition; plain loops say what the types are."""
    rng = random.Random(3)
    gts, dets = crowded(rng, 4, 160, 160)
    gts = [g[:4] + (g[3] or g[4],) for g in gts]
    gt, dt = frames(spark, gts, dets)
    gt, dt = gt.withColumn("category_id", F.col("ann_id") % 3), dt.withColumn("category_id", F.expr("int(dt_id / 4) % 3").cast("long"))
    dt = dt.withColumn("category_id", F.when(F.col("dt_id") == 7, F.lit(None)).otherwise(F.col("category_id")))
    bins, missed = diagnostics.tide_bins(gt, dt, max_dets=30)
    assert "Join" not in bins._jdf.queryExecution().executedPlan().toString()
    got = {r["dt_id"]: r for r in bins.collect()}
    want = {}
    for image in range(4):
        best = sorted((d for d in dets if d[1] == image), key=lambda d: (-d[3], d[0]))[:30]
        own = [g for g in gts if g[1] == image]
        category = {d[0]: None if d[0] == 7 else d[0] // 4 % 3 for d in best}
        for k in (None, 0, 1, 2):
            mine = [d for d in best if category[d[0]] == k]
            edges = [[(g[0], g[0], 0.0, g[4], g[3], v) for g in own if g[0] % 3 == k and (v := iou(g[2], d[2], False)) >= 0.5] for d in mine]
            (picks,) = matching.greedy(edges, (0.5,), lambda e: e[3])
            for d, pick in zip(mine, picks):
                value = lambda same: max(((iou(g[2], d[2], g[3]), -g[0]) for g in own if k is not None and (g[0] % 3 == k) == same), default=(0.0, 0))
                (s, s_id), (c, c_id) = value(True), value(False)
                if pick:
                    want[d[0]] = ("ignore" if pick[3] else "tp", pick[1], 0.0, 0.0)
                elif s >= 0.5 or c >= 0.5:
                    want[d[0]] = ("dupe", -s_id, s, c) if s >= 0.5 else ("cls", -c_id, s, c)
                elif max(s, c) >= 0.1:
                    want[d[0]] = ("loc", -s_id, s, c) if s >= c else ("both", -c_id, s, c)
                else:
                    want[d[0]] = ("bkg", None, s, c)
    assert {i: (r["bin"], r["target"], r["iou_same"], r["iou_cross"]) for i, r in got.items()} == want and len({w[0] for w in want.values()}) >= 6
    hit = {w[1] for w in want.values() if w[0] == "tp"}
    assert sorted(r["ann_id"] for r in missed.collect()) == sorted(g[0] for g in gts if not g[4] and g[0] not in hit)
