"""Detection, mask and keypoint evaluation on small scenes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pixelyard.errors import IncompatibleSummaryPlan, InvalidAnnotation, InvalidConfig, PartitionOverlap, RepeatedImage
from pixelyard.operators import curves, diagnostics, matching
from pixelyard.plans.instance import Evaluator
from pixelyard.plans.params import Area, Boundary, Keypoints, Params, Segm, coco_plan
from pixelyard.sources import coco, manifest
from pixelyard.streaming import partials
from pixelyard.streaming.evaluator import BackgroundEvaluator, StreamingEvaluator

ANN = "id long, image_id long, category_id long, area double, iscrowd string, ignore string, bbox array<double>, segmentation string, keypoints array<double>, num_keypoints int, ord long"


def dataset(spark, anns, images=((1, 640, 480),), categories=((1, "a", None),), masks=False, extra=None):
    rows = [(i, a.get("image", 1), a.get("cat", 1), a.get("area"), a.get("crowd"), a.get("ignore"), a["box"], a.get("seg"), a.get("kp"), a.get("nkp"), i) for i, a in enumerate(anns, 1)]
    image = spark.createDataFrame([(*i, None, *(extra or {}).get(i[0], ([], []))) for i in images], "id long, width int, height int, file_name string, neg_category_ids array<long>, not_exhaustive_category_ids array<long>")
    category = spark.createDataFrame([(c, n, None, f, None) for c, n, f in categories], coco.CATEGORY)
    return coco.ground_truth(image, category, spark.createDataFrame(rows, ANN), masks)


def detections(spark, dets, data=None, masks=False, mode="corrected"):
    rows = [(d.get("id", i), d.get("image", 1), d.get("cat", 1), float(d["score"]), d["box"], None, d.get("seg"), d.get("kp"), None, i) for i, d in enumerate(dets, 1)]
    return coco.detections(spark.createDataFrame(rows, coco.DETECTION + ", ord long"), images=data.images if data else None, masks=masks, mode=mode)


def stats(spark, anns, dets, params=Params(), **kw):
    data = dataset(spark, anns, **kw)
    return Evaluator(params=params).evaluate(data, detections(spark, dets)).stats()


near = lambda x: pytest.approx(x, abs=1e-9)
BOX = [10.0, 10.0, 50.0, 50.0]


def test_perfect_and_disjoint(spark):
    assert stats(spark, [{"box": BOX}], [{"box": BOX, "score": 0.9}])[:3] == near([1.0, 1.0, 1.0])
    far = stats(spark, [{"box": BOX}], [{"box": [300.0, 300.0, 20.0, 20.0], "score": 0.9}])
    assert far[0] == 0.0 and far[3] == -1.0


def test_overlap_of_exactly_a_half_matches(spark):
    out = stats(spark, [{"box": [0.0, 0.0, 100.0, 100.0]}], [{"box": [0.0, 0.0, 100.0, 50.0], "score": 0.9}])
    assert out[1] == near(1.0) and out[2] == 0.0 and abs(out[0] - 0.1) < 1e-12


def test_ties_keep_input_order(spark):
    anns = [{"box": BOX}]
    first = stats(spark, anns, [{"box": BOX, "score": 0.7}, {"box": [300.0, 300.0, 20.0, 20.0], "score": 0.7}])
    second = stats(spark, anns, [{"box": [300.0, 300.0, 20.0, 20.0], "score": 0.7}, {"box": BOX, "score": 0.7}])
    assert first[0] == near(1.0) and abs(second[0] - 0.5) < 1e-9


def test_crowds_take_many_and_do_not_count(spark):
    anns = [{"box": BOX}, {"box": [200.0, 200.0, 200.0, 200.0], "crowd": "1"}]
    dets = [{"box": BOX, "score": 0.9}, {"box": [210.0, 210.0, 20.0, 20.0], "score": 0.95}, {"box": [250.0, 250.0, 20.0, 20.0], "score": 0.96}]
    assert stats(spark, anns, dets)[0] == near(1.0)


def test_images_without_detections_lose_recall(spark):
    out = stats(spark, [{"box": BOX}, {"box": BOX, "image": 2}], [{"box": BOX, "score": 0.9}], images=((1, 640, 480), (2, 640, 480)))
    assert abs(out[8] - 0.5) < 1e-12


def test_an_area_on_the_edge_is_in_both_ranges(spark):
    data = dataset(spark, [{"box": [0.0, 0.0, 32.0, 32.0]}])
    npig = {r["area_idx"]: r["npig"] for r in matching.ground_truth_counts(matching.effective_ignore(data.gt, "corrected"), Params()).collect()}
    assert npig == {0: 1, 1: 1, 2: 1, 3: 0}


def test_modes_differ_on_ignore_and_on_caps(spark):
    anns = [{"box": BOX, "ignore": "1"}, {"box": [100.0, 100.0, 40.0, 40.0]}]
    dets = [{"box": [100.0, 100.0, 40.0, 40.0], "score": 0.9}]
    assert stats(spark, anns, dets)[8] == near(1.0)
    assert stats(spark, anns, dets, Params(mode="strict"))[8] == near(0.5)
    plan = coco_plan("strict")
    assert plan[0].cap_index((1, 10)) is None and coco_plan()[0].cap_index((1, 10)) == 1


def test_strict_stats_agree_with_the_aggregation(spark):
    rng = random.Random(3)
    anns = [{"box": [rng.randrange(300), rng.randrange(300), 20.0 + rng.randrange(60), 30.0], "image": 1 + i % 3, "cat": 1 + i % 2} for i in range(20)]
    anns = [a | {"box": [float(x) for x in a["box"]]} for a in anns]
    dets = [a | {"score": rng.random(), "box": [a["box"][0] + rng.randrange(5), *a["box"][1:]]} for a in anns]
    kw = {"images": tuple((i, 640, 480) for i in (1, 2, 3)), "categories": ((1, "a", None), (2, "b", None))}
    for x, y in zip(stats(spark, anns, dets, **kw), stats(spark, anns, dets, Params(mode="strict"), **kw), strict=True):
        assert abs(x - y) < 1e-9


def brute(edges, thr):
    """The sequential rule, written out plainly."""
    taken, out = set(), []
    for own in edges:
        best, pick = min(thr, 1 - 1e-10), None
        for e in sorted(own, key=lambda e: (e[3], e[0])):
            if e[1] in taken and not e[4]:
                continue
            if pick and not pick[3] and e[3]:
                break
            if e[5] >= best:
                best, pick = e[5], e
        if pick:
            taken.add(pick[1])
        out.append(pick[1] if pick else None)
    return out


def test_greedy_against_the_plain_rule():
    rng = random.Random(5)
    for _ in range(300):
        gts = [(o, 100 + o, 1.0, rng.random() < 0.3, rng.random() < 0.2) for o in range(rng.randrange(6))]
        edges = [[(*g, rng.choice([0.5, 0.6, 0.7, 0.75, 0.9])) for g in gts if rng.random() < 0.7] for _ in range(rng.randrange(6))]
        got = matching.greedy(edges, (0.5, 0.75), lambda e: e[3])
        for thr, found in zip((0.5, 0.75), got, strict=True):
            assert [p[1] if p else None for p in found] == brute(edges, thr)


def test_split_running_sums_equal_one_window(spark):
    rows = spark.createDataFrame([(i % 2, (i * 37 % 50) / 50, i) for i in range(400)], "k int, s double, i long")
    order = [F.desc("s"), F.asc("i")]
    one, many = (sorted(map(tuple, curves.running(rows, ["k"], order, {"n": F.lit(1), "t": F.col("i")}, split).select("k", "s", "i", "n", "t").collect())) for split in (False, True))
    assert one == many


def test_custom_grid_needs_tables(spark):
    data, dt = dataset(spark, [{"box": BOX}]), detections(spark, [{"box": BOX, "score": 0.9}])
    custom = Evaluator(params=Params(iou_thresholds=(0.5,), areas=(Area("all", 0, 1e10),)))
    with pytest.raises(IncompatibleSummaryPlan):
        custom.evaluate(data, dt)
    assert custom.evaluate_tables(data, dt).per_class().first()["ap"] == near(1.0)
    with pytest.raises(InvalidConfig):
        Params(iou_thresholds=(0.6, 0.5))


def test_ingest_guards(spark):
    with pytest.raises(InvalidAnnotation):
        coco.check(dataset(spark, [{"box": BOX, "cat": 9}]))
    with pytest.raises(Exception, match="iscrowd must be 0 or 1"):
        dataset(spark, [{"box": BOX, "crowd": "2"}]).gt.collect()
    with pytest.raises(Exception, match="isn't a number"):
        detections(spark, [{"box": BOX, "score": float("nan")}]).collect()


SQUARE = "[[10,10,10,60,60,60,60,10]]"


def test_masks_and_boundaries(spark):
    data = dataset(spark, [{"box": BOX, "seg": SQUARE}], images=((1, 100, 100),), masks=True)
    half = "[[10,10,10,60,35,60,35,10]]"
    dt = detections(spark, [{"box": BOX, "seg": SQUARE, "score": 0.9}, {"box": [10.0, 10.0, 25.0, 50.0], "seg": half, "score": 0.8}], data, masks=True)
    for kernel in (Segm(), Boundary()):
        result = Evaluator(kernel).evaluate(data, dt)
        assert result.stats()[0] == near(1.0)
        ious = {r["dt_id"]: r["iou"] for r in result.pairs(0.0).collect()}
        assert ious[1] == near(1.0) and (abs(ious[2] - 0.5) < 1e-12 if isinstance(kernel, Segm) else ious[2] < 0.5)


def test_keypoints(spark):
    kp = [float(x) for k in range(17) for x in (20 + k, 30 + 2 * k, 2)]
    data = dataset(spark, [{"box": BOX, "kp": kp, "nkp": 17, "area": 2500.0}])
    moved = [x + 3 if i % 3 == 0 else x for i, x in enumerate(kp)]
    dt = detections(spark, [{"box": BOX, "kp": kp, "score": 0.9}])
    assert Evaluator(Keypoints()).evaluate(data, dt).stats()[0] == near(1.0)
    far = Evaluator(Keypoints()).evaluate(data, detections(spark, [{"box": BOX, "kp": moved, "score": 0.9}])).pairs(0.0).first()["iou"]
    import math

    from pixelyard.functions.geometry import COCO_SIGMAS

    assert abs(far - sum(math.exp(-9 / (2 * s) ** 2 / (2500.0 + 2.220446049250313e-16) / 2) for s in COCO_SIGMAS) / 17) < 1e-12


def test_federated(spark):
    kw = {"images": ((1, 640, 480), (2, 640, 480)), "categories": ((1, "f", "f"), (2, "c", "c"), (3, "r", "r")), "extra": {1: ([2], []), 2: ([], [1])}}
    data = dataset(spark, [{"box": BOX}, {"box": BOX, "image": 2}], **kw)
    coco.check_federated(data)
    dt = detections(spark, [{"box": BOX, "score": 0.9}, {"box": BOX, "cat": 2, "score": 0.8}, {"box": BOX, "cat": 3, "score": 0.7}, {"box": BOX, "image": 2, "score": 0.6}, {"box": [300.0, 300.0, 20.0, 20.0], "image": 2, "score": 0.95}])
    result = Evaluator().evaluate(data, dt)
    out = result.stats()
    assert len(out) == 13 and out[0] == near(1.0) and out[6] == -1.0 and out[8] == near(1.0)
    assert result.matches.where("category_id = 3").count() == 0
    with pytest.raises(InvalidConfig):
        Evaluator().confusion_matrix(data, dt)


def scene(spark):
    anns = [{"box": BOX}, {"box": [200.0, 200.0, 50.0, 50.0], "cat": 2}, {"box": [400.0, 50.0, 60.0, 60.0]}]
    dets = [
        {"box": BOX, "score": 0.9},
        {"box": [12.0, 10.0, 50.0, 50.0], "score": 0.8},
        {"box": [200.0, 200.0, 50.0, 50.0], "cat": 1, "score": 0.7},
        {"box": [430.0, 50.0, 60.0, 60.0], "score": 0.6},
        {"box": [600.0, 400.0, 10.0, 10.0], "score": 0.5},
    ]
    return dataset(spark, anns, categories=((1, "a", None), (2, "b", None))), detections(spark, dets)


def test_error_types_and_confusion(spark):
    data, dt = scene(spark)
    gt = data.gt.withColumn("ign", F.lit(False))
    bins, missed = diagnostics.tide_bins(gt, dt)
    assert {r["dt_id"]: r["bin"] for r in bins.collect()} == {1: "tp", 2: "dupe", 3: "cls", 4: "loc", 5: "bkg"}
    assert sorted(r["ann_id"] for r in missed.collect()) == [2, 3]
    matrix = {(r["gt_class"], r["dt_class"]): r["n"] for r in Evaluator().confusion_matrix(data, dt).collect()}
    assert matrix == {("1", "1"): 1, ("2", "1"): 1, ("__none__", "1"): 3, ("1", "__none__"): 1}
    assert sum(r["n"] for r in Evaluator().fp_iou_histogram(data, dt).collect()) == 8


def test_mended_versions_equal_single_evaluations(spark):
    data, dt = scene(spark)
    deltas = {r["fix"]: r["map"] for r in Evaluator().error_decomposition(data, dt).collect()}
    ap = lambda d, g=data.gt: Evaluator().evaluate(coco.Dataset(data.images, data.categories, g), d).values().where("area_idx = 0 AND m_idx = 2").agg(F.avg("ap")).first()[0]
    assert abs(deltas["base"] - ap(dt)) < 1e-12
    assert abs(deltas["cls"] - ap(dt.withColumn("category_id", F.when(F.col("dt_id") == 3, 2).otherwise(F.col("category_id")).cast("long")))) < 1e-12
    assert abs(deltas["dupe"] - ap(dt.where("dt_id <> 2"))) < 1e-12
    assert abs(deltas["bkg"] - ap(dt.where("dt_id <> 5"))) < 1e-12
    assert abs(deltas["missed"] - ap(dt, data.gt.where("ann_id = 1"))) < 1e-12
    assert abs(deltas["all_fp"] - ap(dt.where("dt_id = 1"))) < 1e-12


def test_optimal_lrp(spark):
    data, dt = scene(spark)
    per_class, report = Evaluator().optimal_lrp(data, dt)
    rows = {r["category_id"]: r for r in per_class.collect()}
    best = min(((n_fp + (2 - tp)) / (tp + n_fp + 2 - tp), -s) for s, tp, n_fp in ((0.9, 1, 0), (0.8, 1, 1), (0.7, 1, 2)))
    assert abs(rows[1]["olrp"] - best[0]) < 1e-12 and rows[1]["tau"] == 0.9 and rows[1]["olrp_fn"] == 0.5
    assert rows[2]["olrp"] == 1.0 and rows[2]["olrp_loc"] is None and rows[2]["tau"] is None
    assert abs(report.first()["olrp"] - (best[0] + 1) / 2) < 1e-12


def test_tables_slices_and_metrics(spark):
    images = ((1, 640, 480), (2, 640, 480), (3, 640, 480))
    data = dataset(spark, [{"box": BOX}, {"box": BOX, "image": 2}], images=images)
    dt = detections(spark, [{"box": BOX, "score": 0.9}, {"box": [300.0, 300.0, 20.0, 20.0], "image": 2, "score": 0.8}])
    result = Evaluator().evaluate(data, dt)
    table = {r["image_id"]: (r["n_gt"], r["n_dt"], r["tp_50"], r["fp_50"], r["fn_50"], r["tp_mean"]) for r in result.per_image().collect()}
    assert table == {1: (1, 1, 1, 0, 0, 1), 2: (1, 1, 0, 1, 1, 0), 3: (0, 0, 0, 0, 0, 0)}
    assert {r["dt_id"]: r["status"] for r in result.per_detection().collect()} == {1: "tp", 2: "fp"}
    man = manifest.from_rows(spark, [{"key": 1, "w": "sun"}, {"key": 2, "w": "rain"}])
    by = {(r["axis"], r["value"]): r["result"] for r in result.sliced(man).where("ord = 0").collect()}
    assert by[("w", "sun")] == near(1.0) and by[("w", "rain")] == 0.0 and by[("overall", "all")] == near(result.stats()[0])
    assert result.metrics()["map"] == near(result.stats()[0]) and "mar_100" in result.metrics()
    assert result.text()[0].startswith(" Average Precision")
    with pytest.raises(InvalidConfig):
        manifest.from_rows(spark, [{"key": 1, "w": 3}])


def random_scene(spark, n=12):
    rng = random.Random(8)
    anns = [{"box": [float(rng.randrange(300)), float(rng.randrange(300)), 30.0, 40.0], "image": 1 + i % 4, "cat": 1 + i % 2} for i in range(n)]
    dets = [a | {"score": rng.random(), "box": [a["box"][0] + rng.randrange(9), *a["box"][1:]]} for a in anns]
    kw = {"images": tuple((i, 640, 480) for i in range(1, 5)), "categories": ((1, "a", None), (2, "b", None))}
    return dataset(spark, anns, **kw), detections(spark, dets)


def test_streams_and_ranks_equal_the_batch(spark, tmp_path):
    data, dt = random_scene(spark)
    whole = Evaluator().evaluate(data, dt).stats()
    stream = StreamingEvaluator(Evaluator(), data, f"file://{tmp_path}/s")
    stream.update(dt.where("image_id <= 2"))
    with pytest.raises(RepeatedImage):
        stream.update(dt.where("image_id = 2"))
    background = BackgroundEvaluator(stream)
    background.submit(dt.where("image_id > 2"))
    assert background.finalize().stats() == pytest.approx(whole, abs=1e-12)
    for rank, part in enumerate(("image_id < 3", "image_id >= 3")):
        partials.write(Evaluator(), data, dt.where(part), rank, f"file://{tmp_path}/r{rank}")
    paths = [f"file://{tmp_path}/r{i}" for i in range(2)]
    assert partials.merge(spark, Evaluator(), data, paths).stats() == pytest.approx(whole, abs=1e-12)
    with pytest.raises(PartitionOverlap):
        partials.merge(spark, Evaluator(), data, [paths[0], paths[0]])


def test_structured_stream(spark, tmp_path):
    data, dt = random_scene(spark)
    for i in range(2):
        dt.where(F.col("image_id") % 2 == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(dt.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream = StreamingEvaluator(Evaluator(), data, f"file://{tmp_path}/out")
    stream.start(source, f"file://{tmp_path}/check").awaitTermination(120)
    assert stream.snapshot().stats() == pytest.approx(Evaluator().evaluate(data, dt).stats(), abs=1e-12)


def test_result_does_not_depend_on_partitioning(spark):
    data, dt = random_scene(spark)
    a, b = (Evaluator().evaluate(coco.Dataset(data.images, data.categories, data.gt.repartition(n)), dt.repartition(n)).stats() for n in (1, 7))
    assert a == pytest.approx(b, abs=1e-12)


def test_collapsed_categories(spark):
    data, dt = scene(spark)
    out = Evaluator(params=Params(use_cats=False)).evaluate(data, dt)
    assert [r["category_id"] for r in out.matches.select("category_id").distinct().collect()] == [-1]


def test_calibration(spark):
    data, dt = random_scene(spark, 40)
    bins, errors = Evaluator().evaluate(data, dt).calibration(n_bins=4)
    rows = bins.collect()
    assert len(rows) == 4 and sum(r["count"] for r in rows) == errors.first()["n"]
    assert all(0 <= r["ci_lo"] <= r["accuracy"] + 1e-9 and r["accuracy"] <= r["ci_hi"] + 1e-9 for r in rows if r["count"])
