"""Kernels in the diagnostics, restarts, filters, states of every paradigm, the evaluator shim."""

from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_instance import dataset, detections, random_scene
from test_masks_panoptic_semantic import panoptic_case

from pixelyard.compat import COCOeval
from pixelyard.errors import InvalidConfig, PartialMismatch, RepeatedImage
from pixelyard.operators import curves, matching
from pixelyard.plans import panoptic, semantic
from pixelyard.plans.instance import Evaluator
from pixelyard.plans.params import Bbox, Boundary, ByGroup, ByIds, Params, Segm
from pixelyard.sources import coco
from pixelyard.streaming import partials
from pixelyard.streaming.evaluator import StreamingEvaluator


def square(x, y, n):
    return json.dumps([[x, y, x, y + n, x + n, y + n, x + n, y]])


def masked(spark):
    """One pair of equal boxes whose masks don't meet, one pair of equal masks, one that is off by its class."""
    low, high = json.dumps([[0, 0, 0, 20, 20, 20]]), json.dumps([[0, 0, 20, 0, 20, 20]])
    anns = [{"box": [0.0, 0.0, 20.0, 20.0], "seg": low}, {"box": [40.0, 40.0, 20.0, 20.0], "seg": square(40, 40, 20)}, {"box": [10.0, 70.0, 20.0, 20.0], "seg": square(10, 70, 20), "cat": 2}]
    dets = [{"box": [0.0, 0.0, 20.0, 20.0], "seg": high, "score": 0.9}, {"box": [40.0, 40.0, 20.0, 20.0], "seg": square(40, 40, 20), "score": 0.8}, {"box": [10.0, 70.0, 20.0, 20.0], "seg": square(10, 70, 20), "score": 0.7}, {"box": [0.0, 0.0, 9.0, 9.0], "seg": square(0, 0, 9), "score": 0.5, "image": 99}]
    data = dataset(spark, anns, images=((1, 100, 100),), categories=((1, "a", None), (2, "b", None)), masks=True)
    images = data.images.unionByName(data.images.withColumn("image_id", F.lit(99).cast("long")))
    dt = detections(spark, dets, coco.Dataset(images, data.categories, data.gt), masks=True)
    return data, dt


@pytest.mark.parametrize("kernel", [Segm(), Boundary(0.05)])
def test_diagnostics_look_at_masks(spark, kernel):
    data, dt = masked(spark)
    matrix = {(r["gt_class"], r["dt_class"]): r["n"] for r in Evaluator(kernel).confusion_matrix(data, dt).collect()}
    assert matrix == {("1", "1"): 1, ("1", "__none__"): 1, ("__none__", "1"): 1, ("2", "1"): 1}  # the unknown image's detection counts nowhere
    boxes = {(r["gt_class"], r["dt_class"]): r["n"] for r in Evaluator().confusion_matrix(data, dt).collect()}
    assert boxes == {("1", "1"): 2, ("2", "1"): 1}
    bins = {r["dt_id"]: r for r in Evaluator(kernel).tide_bins(data, dt)[0].collect()}
    # the match itself is always by boxes; the class error is the mask's
    assert bins[1]["bin"] == "tp" and bins[2]["bin"] == "tp" and bins[3]["bin"] == "cls" and bins[3]["iou_cross"] == 1.0
    histogram = {(r["kind"], r["bin"]): r["n"] for r in Evaluator(kernel).fp_iou_histogram(data, dt).collect()}
    assert histogram == {("same", 0): 1, ("cross", 19): 1}
    maps = {r["fix"]: r["map"] for r in Evaluator(kernel).error_decomposition(data, dt).collect()}
    assert maps["base"] == pytest.approx(Evaluator(kernel).evaluate(data, dt).metrics()["map"]) and maps["cls"] > maps["base"]
    assert {r["fix"]: r["map"] for r in Evaluator().error_decomposition(data, dt).collect()}["base"] == pytest.approx(Evaluator().evaluate(data, dt).metrics()["map"])


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    data, dt = random_scene(spark)
    path = f"file://{tmp_path}/s"
    StreamingEvaluator(Evaluator(), data, path).update(dt.where("image_id <= 2"))
    again = StreamingEvaluator(Evaluator(), data, path)
    with pytest.raises(RepeatedImage):
        again.update(dt.where("image_id = 2"))
    # what a failure leaves of a batch isn't read
    again.evaluator.match(data, dt.where("image_id = 4")).matches.write.parquet(f"{path}/matches/batch=update-1")
    again.update(dt.where("image_id = 3"))
    again.update(dt.where("image_id = 4"))
    assert again.seen().count() == 4 and again.seen().select("batch").distinct().count() == 3
    assert again.snapshot().stats() == pytest.approx(Evaluator().evaluate(data, dt).stats(), abs=1e-12)
    assert again.snapshot().per_image().count() == 4


def test_filters_groups_and_slices_of_lrp(spark):
    data, dt = random_scene(spark)
    out = Evaluator().evaluate(data, dt)
    first = lambda df: df.where("ord = 0").first()["value"]
    own = {r["category_id"]: r["ap"] for r in out.per_class().collect()}
    assert first(out.summary(ByIds(frozenset({1})))) == pytest.approx(own[1]) and first(out.summary(ByIds(frozenset({9})))) is None
    groups = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2)], "label string, category_id long")
    assert first(out.summary(ByGroup("y"), groups)) == pytest.approx(own[2])
    assert {r["label"]: r["value"] for r in out.by_group(groups).where("ord = 0").collect()} == {"x": pytest.approx((own[1] + own[2]) / 2), "y": pytest.approx(own[2])}
    with pytest.raises(InvalidConfig):
        out.summary(ByGroup("z"), groups)
    man = spark.createDataFrame([(1, "sun"), (2, "sun"), (3, "rain")], "key long, w string")
    per_class, report = Evaluator().sliced_lrp(data, dt, man)
    plain, whole = Evaluator().optimal_lrp(data, dt)
    rows = {(r["axis"], r["value"]): r["olrp"] for r in report.collect()}
    assert set(rows) == {("w", "sun"), ("w", "rain"), ("w", "__unassigned__"), ("overall", "all")} and rows["overall", "all"] == pytest.approx(whole.first()["olrp"])
    some = coco.Dataset(data.images.where("image_id <= 2"), data.categories, data.gt.where("image_id <= 2"))
    assert rows["w", "sun"] == pytest.approx(Evaluator().optimal_lrp(some, dt)[1].first()["olrp"])


def test_states_of_every_paradigm(spark, tmp_path):
    pairs, gt, dt = panoptic_case(spark, [[1, 1, 2, 2]], [[1, 1, 2, 3]], {1: 1, 2: 2}, {1: 1, 2: 2, 3: 2})
    kinds = spark.createDataFrame([(1, True), (2, False)], "category_id long, isthing boolean")
    evaluator = panoptic.Evaluator()
    whole = evaluator.evaluate(kinds, gt, dt, pairs)
    other = panoptic.Result(whole.stats.withColumn("image_id", F.col("image_id") + 100), kinds, evaluator.mode)
    for rank, part in enumerate((whole, other)):
        partials.write_panoptic(evaluator, part, rank, f"file://{tmp_path}/p{rank}")
    merged = partials.merge_panoptic(spark, evaluator, kinds, [f"file://{tmp_path}/p{i}" for i in range(2)])
    assert merged.to_dict()["all"] == whole.to_dict()["all"] and merged.stats.count() == 2 * whole.stats.count()
    with pytest.raises(PartialMismatch):
        partials.merge_panoptic(spark, panoptic.Evaluator(threshold=0.6), kinds, [f"file://{tmp_path}/p0"])
    spark.read.parquet(f"file://{tmp_path}/p0/state").limit(1).write.mode("append").parquet(f"file://{tmp_path}/p1/state")
    with pytest.raises(PartialMismatch, match="content"):
        partials.merge_panoptic(spark, evaluator, kinds, [f"file://{tmp_path}/p1"])
    runs = spark.createDataFrame([(i, g, d, 5) for i in (1, 2) for g in (0, 1) for d in (0, 1)], "image_id long, gt_class int, dt_class int, n long")
    maps = semantic.Evaluator(2)
    for i in (1, 2):
        partials.write_semantic(maps, maps.evaluate(runs.where(F.col("image_id") == i)), i, f"file://{tmp_path}/m{i}")
    merged = partials.merge_semantic(spark, maps, [f"file://{tmp_path}/m{i}" for i in (1, 2)])
    assert merged.summary().first() == maps.evaluate(runs).summary().first()


def test_the_customary_evaluator(spark, capsys):
    data, dt = random_scene(spark)
    e = COCOeval(data, dt, "bbox")
    e.evaluate()
    e.accumulate()
    e.summarize()
    assert e.stats == pytest.approx(Evaluator(params=Params(mode="strict")).evaluate(data, dt).stats()) and "Average Recall" in capsys.readouterr().out
    precision = e.eval["precision"]
    assert precision.shape == (10, 101, 2, 4, 3) and precision[:, :, :, 0, 2].mean() == pytest.approx(e.stats[0])
    assert e.eval["recall"][:, :, 0, 2].mean() == pytest.approx(e.stats[8])
    some = COCOeval(data, dt, "bbox")
    some.params.imgIds, some.params.catIds = [1], [1]
    some.evaluate()
    ious = some.ious
    assert set(ious) == {(1, 1)} and ious[1, 1].max() <= 1.0 and {r["image_id"] for r in some.evalImgs} == {1}
    with pytest.raises(InvalidConfig):
        COCOeval(data, dt, "bbox").accumulate()


def test_many_thresholds_and_competition(spark):
    """Crowded cells against the plain rule, detection by detection, at sixty thresholds."""
    rng = random.Random(5)
    box = lambda: [float(rng.randrange(0, 30)), float(rng.randrange(0, 30)), float(rng.randrange(10, 30)), float(rng.randrange(10, 30))]
    anns = [{"box": box(), "image": 1 + i % 3, "crowd": "1" if i % 7 == 0 else None, "area": float(rng.choice((500, 1024, 2000)))} for i in range(40)]
    dets = [{"box": box(), "image": 1 + i % 3, "score": rng.choice((0.2, 0.5, 0.9))} for i in range(60)]
    data = dataset(spark, anns, images=tuple((i, 100, 100) for i in range(1, 4)))
    dt = detections(spark, dets, data)
    params = Params(iou_thresholds=tuple(np.linspace(0.05, 0.95, 60).tolist()))
    got = {r["dt_id"]: r for r in Evaluator(params=params).evaluate_tables(data, dt).matches.collect()}
    edges = {}
    gt = matching.effective_ignore(data.gt, params.mode)
    ranked = matching.top_k(dt, 100)
    for r in matching.scored_pairs(gt, ranked, min(params.seeds)).collect():
        e = r["edge"]
        edges.setdefault((r["image_id"], r["category_id"]), {}).setdefault(r["dt_id"], []).append((e["g_ord"], e["ann_id"], e["g_area"], e["ign"], e["crowd"], e["iou"]))
    for r in ranked.collect():
        edges.setdefault((r["image_id"], r["category_id"]), {}).setdefault(r["dt_id"], [])
    rank = {r["dt_id"]: (r["rank"], r["area"]) for r in ranked.collect()}
    for cell in edges.values():
        order = sorted(cell, key=lambda d: rank[d][0])
        for a, area in enumerate(params.areas):
            off = lambda e, area=area: e[3] or not area.lo <= e[2] <= area.hi
            for t, taken in enumerate(matching.greedy([cell[d] for d in order], params.seeds, off)):
                for d, pick in zip(order, taken, strict=True):
                    outside = not area.lo <= rank[d][1] <= area.hi
                    assert got[d]["matched"][a] >> t & 1 == (pick is not None)
                    assert got[d]["ignored"][a] >> t & 1 == (off(pick) if pick is not None else outside)
                    assert (got[d]["gts"][a] or [None] * 60)[t] == (pick[1] if pick is not None else None)


def test_cells_may_span_batches_and_curves_may_be_split(spark, monkeypatch):
    data, dt = random_scene(spark, 60)
    whole = Evaluator().evaluate(data, dt)
    expected = sorted(map(str, whole.matches.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = Evaluator().evaluate(data, dt)
        assert sorted(map(str, again.matches.collect())) == expected
        values = lambda r, split: sorted(map(tuple, curves.lane_values(r.matches, r.npig, r.params, split=split).collect()))
        small = values(again, False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for other in (values(whole, False), values(whole, True)):
        assert [r[:4] for r in other] == [r[:4] for r in small] and np.allclose([r[4:] for r in other], [r[4:] for r in small], atol=1e-12)


def test_command_line_options(spark, tmp_path, capsys):
    from pixelyard import cli

    gt = {"images": [{"id": 1, "width": 100, "height": 100}], "categories": [{"id": 1, "name": "a"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "area": 400, "iscrowd": 0, "bbox": [10, 10, 20, 20]}]}
    dt = [{"image_id": 1, "category_id": 1, "score": 0.9, "bbox": [10, 10, 20, 20]}]
    for name, document in (("gt", gt), ("dt", dt)):
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    run = lambda *options: cli.main(["eval", str(tmp_path / "gt.json"), str(tmp_path / "dt.json"), *options])
    assert run("--lrp", "--tables", f"file://{tmp_path}/t", "--result-version", "2", "--json", str(tmp_path / "o.json")) == 0
    out = json.loads((tmp_path / "o.json").read_text())
    assert out["lines"][0]["name"] == "AP_0.50:0.95_all_100" and out["lrp"]["olrp"] == pytest.approx(0.0) and "Optimal LRP" in capsys.readouterr().out
    assert spark.read.parquet(f"file://{tmp_path}/t/per_detection").count() == 1
    assert run("--iou-thresholds", "0.3,0.6", "--no-cats") == 0
    (tmp_path / "s.json").write_text('{"1": [-1]}')
    assert run("--iou-type", "keypoints", "--sigmas", str(tmp_path / "s.json")) == 1


def test_arrow_helper_fills_blanks():
    batch = pa.RecordBatch.from_pydict({c: pa.array([None], pa.bool_() if c in ("open", "ign", "crowd") else pa.float64() if c in ("score", "area", "g_area", "iou") else pa.int64()) for c in [*matching._FLAT, "n"]})
    out = matching._arrays(batch)
    assert not out["has"][0] and np.isnan(out["area"][0]) and out["dt_id"][0] == 0
    assert Bbox().name == "bbox"
