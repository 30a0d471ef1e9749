"""Masks, label maps, panoptic and semantic operators on small inputs."""

from __future__ import annotations

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelyard.errors import DimensionMismatch, InvalidAnnotation, RepeatedImage, TooManySlices, UnknownImage
from pixelyard.operators import calibration, masks, panoptic, semantic, slices
from pixelyard.sources import png
from pixelyard.streaming.evaluator import StreamingSums


def test_run_lengths_against_rasters():
    rng = np.random.default_rng(1)
    for _ in range(200):
        h, w = (int(x) for x in rng.integers(1, 12, 2))
        a, b = ((rng.random((h, w)) < rng.random()).astype(np.uint8) for _ in range(2))
        ca, cb = masks.encode(a), masks.encode(b)
        assert (masks.decode(ca, h, w) == a).all() and masks.area(ca) == a.sum() and masks.overlap(ca, cb) == (a & b).sum()
        assert (masks.decode(masks.merge([ca, cb], h * w), h, w) == (a | b)).all()
        assert (masks.decode(masks.merge([ca, cb], h * w, intersect=True), h, w) == (a & b)).all()
        assert masks.from_text(masks.to_text(ca)) == ca.tolist()
        d = int(rng.integers(1, 3))
        inside = [[all(0 <= y + i < h and 0 <= x + j < w and a[y + i, x + j] for i in range(-d, d + 1) for j in range(-d, d + 1)) for x in range(w)] for y in range(h)]
        assert (masks.erode(a, d) == np.array(inside)).all()


def test_polygons_and_guards():
    assert masks.area(masks.from_polygon([0, 0, 0, 10, 10, 10, 10, 0], 10, 10)) == 100
    assert masks.bounds(masks.from_box(2, 3, 4, 5, 20, 20), 20) == (2.0, 3.0, 4.0, 5.0)
    two = masks.from_polygons([[0, 0, 0, 4, 4, 4, 4, 0], [2, 2, 2, 6, 6, 6, 6, 2]], 10, 10)
    assert masks.area(two) == 16 + 16 - 4
    assert masks.radius(0.02, 480, 640) == 16 and masks.radius(0.001, 10, 10) == 1
    with pytest.raises(DimensionMismatch):
        masks.merge([[4], [5]], 4)
    with pytest.raises(InvalidAnnotation):
        masks.from_text("o")


def test_run_length_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, masks.encode(rng.random((6, 7)) < 0.5).tolist(), masks.encode(rng.random((6, 7)) < 0.5).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, a array<long>, b array<long>")
    spans = lambda c: masks.rle_spans(F.col(c))
    out = df.select("id", masks.rle_area(F.col("a")).alias("area"), masks.rle_overlap(spans("a"), spans("b")).alias("inter"))
    assert {r["id"]: (r["area"], r["inter"]) for r in out.collect()} == {i: (masks.area(a), masks.overlap(a, b)) for i, a, b in rows}


def write_png(pixels: np.ndarray, kind: int) -> bytes:
    h, w, c = pixels.shape
    raw, above = b"", np.zeros(w * c, np.int64)
    for y in range(h):
        row = pixels[y].ravel().astype(np.int64)
        left = np.concatenate([np.zeros(c, np.int64), row[:-c]])
        corner = np.concatenate([np.zeros(c, np.int64), above[:-c]])
        guess = left + above - corner
        paeth = np.where((abs(guess - left) <= abs(guess - above)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - above) <= abs(guess - corner), above, corner))
        minus = {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: paeth}[kind]
        raw += bytes([kind]) + ((row - minus) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_filters(spark, tmp_path):
    rng = np.random.default_rng(2)
    for c in (1, 3):
        pixels = rng.integers(0, 256, (5, 4, c), dtype=np.uint8)
        for kind in range(5):
            assert (png.decode(write_png(pixels, kind)) == pixels).all()
    (tmp_path / "a.png").write_bytes(write_png(np.array([[[1, 1, 0], [1, 1, 0], [2, 0, 1]]], np.uint8), 0))
    out = sorted(tuple(r)[1:] for r in png.read_runs(spark, str(tmp_path)).collect())
    assert out == [(0, 2, 257), (2, 1, 65538)]
    with pytest.raises(InvalidAnnotation):
        png.decode(b"no")


def panoptic_case(spark, gt_map, dt_map, gt_cats, dt_cats, crowds=()):
    runs = lambda m: spark.createDataFrame([(1, int(s), int(n), int(k)) for s, n, k in zip(*png.runs(np.array(m)), strict=True)], "image_id long, start long, len long, segment_id long")
    sizes = lambda m: {k: int((np.array(m) == k).sum()) for k in set(np.array(m).ravel().tolist()) - {0}}
    gt = spark.createDataFrame([(1, k, gt_cats[k], n, k in crowds) for k, n in sizes(gt_map).items()], "image_id long, segment_id long, category_id long, area long, iscrowd boolean")
    dt = spark.createDataFrame([(1, k, dt_cats[k], n) for k, n in sizes(dt_map).items()], "image_id long, segment_id long, category_id long, area long")
    return panoptic.overlaps(runs(gt_map), runs(dt_map)), gt, dt


def test_panoptic_thresholds_and_attribution(spark):
    pairs, gt, dt = panoptic_case(spark, [[1, 1, 0, 2]], [[1, 3, 3, 2]], {1: 1, 2: 2}, {1: 1, 3: 1, 2: 2})
    # an overlap of exactly a half doesn't match
    stats = {r["category_id"]: tuple(r)[2:] for r in panoptic.attribution(pairs, gt, dt).collect()}
    assert stats == {1: (0.0, 0, 2, 1), 2: (1.0, 1, 0, 0)}
    classes = panoptic.per_class(panoptic.attribution(pairs, gt, dt))
    kinds = spark.createDataFrame([(1, True), (2, False), (3, True)], "category_id long, isthing boolean")
    means = {r["label"]: (r["pq"], r["n"]) for r in panoptic.average(classes, kinds).collect()}
    assert means == {"all": (0.5, 2), "things": (0.0, 1), "stuff": (1.0, 1)}
    low = panoptic.matched_segments(pairs, gt, dt, 0.2).collect()
    assert {(r["gt_id"], r["dt_id"]) for r in low} == {(1, 1), (2, 2)}


def test_panoptic_crowds_and_void(spark):
    pairs, gt, dt = panoptic_case(spark, [[5, 5, 5, 0, 0, 0, 0, 7]], [[5, 5, 4, 4, 4, 4, 0, 6]], {5: 1, 7: 1}, {5: 1, 4: 2, 6: 2}, crowds=(5,))
    stats = {r["category_id"]: tuple(r)[2:] for r in panoptic.attribution(pairs, gt, dt).collect()}
    # 5 lies in a crowd of its class, 4 mostly in void; 6 is false, 7 is lost
    assert stats == {1: (0.0, 0, 0, 1), 2: (0.0, 0, 1, 0)}
    with pytest.raises(InvalidAnnotation):
        panoptic.validate(gt.unionByName(gt), spark.createDataFrame([(1,)], "category_id long"))


def test_semantic_literal_case(spark):
    gt = np.array([[0, 0, 1, 1], [0, 0, 1, 1], [2, 2, 255, 255], [2, 2, 255, 255]])
    dt = np.array([[0, 0, 1, 1], [0, 1, 1, 1], [2, 2, 0, 1], [2, 0, 2, 2]])
    runs = spark.createDataFrame([(1, int(g), int(d), 1) for g, d in zip(gt.ravel(), dt.ravel(), strict=True)], "image_id long, gt_class int, dt_class int, n long")
    classes = semantic.per_class(semantic.confusion(runs, 3, 255), 3)
    rows = {r["class_id"]: r for r in classes.collect()}
    assert [round(rows[k]["iou"], 9) for k in range(3)] == [0.6, 0.8, 0.75] and [rows[k]["recall"] for k in range(3)] == [0.75, 1.0, 0.75]
    out = semantic.summary(classes).first()
    assert out["pixel_accuracy"] == pytest.approx(10 / 12) and out["miou"] == pytest.approx((0.6 + 0.8 + 0.75) / 3)
    with pytest.raises(UnknownImage):
        semantic.require_coverage(runs, runs.where("false"))
    assert semantic.remap(runs, {2: 1}, "gt_class").where("gt_class = 2").count() == 0


def test_streamed_counts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i % 5, rng.randrange(3), rng.randrange(3), 1 + rng.randrange(4)) for i in range(60)]
    runs = spark.createDataFrame(rows, "image_id long, gt_class int, dt_class int, n long")
    stream = StreamingSums(spark, f"file://{tmp_path}/s", lambda b: semantic.confusion(b, 3), ["gt_class", "dt_class"])
    for part in ("image_id < 2", "image_id >= 2"):
        stream.update(runs.where(part))
    with pytest.raises(RepeatedImage):
        stream.update(runs.where("image_id = 4"))
    assert sorted(map(tuple, stream.snapshot().collect())) == sorted(map(tuple, semantic.confusion(runs, 3).collect()))


def test_quantiles_equal_numpy(spark):
    rng = random.Random(2)
    values = [rng.choice([0.1, 0.25, rng.random()]) for _ in range(97)]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    shares = [i / 15 for i in range(16)]
    for split in (False, True):
        assert calibration.quantiles(df, "score", shares, split) == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12)


def test_slices(spark):
    images = spark.createDataFrame([(i,) for i in range(1, 5)], "image_id long")
    man = spark.createDataFrame([(1, "sun", "day"), (2, "rain", "day"), (3, "sun", None)], "key long, w string, t string")
    out = {(r["axis"], r["value"], r["image_id"]) for r in slices.slices(man, images, (("w", "t"),)).collect()}
    assert ("w", "__unassigned__", 4) in out and ("w::t", "sun::day", 1) in out and ("w::t", "__unassigned__", 3) in out
    with pytest.raises(TooManySlices):
        slices.slices(man, images, cap=2)
    res = spark.createDataFrame([("clean", "c", 0.8), ("w", "sun", 0.6), ("w", "rain", 0.2)], "axis string, value string, ap double")
    (r,) = slices.robustness(res, "ap", ("clean", "c")).collect()
    assert (r["mpc"], r["rpc"]) == (pytest.approx(0.4), pytest.approx(0.5))


def test_command_line(spark, tmp_path, capsys):
    from pixelyard import cli

    gt = {"images": [{"id": 1, "width": 100, "height": 100}], "categories": [{"id": 1, "name": "a"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "area": 400, "iscrowd": 0, "bbox": [10, 10, 20, 20], "segmentation": [[10, 10, 10, 30, 30, 30, 30, 10]]}]}
    dt = [{"image_id": 1, "category_id": 1, "score": 0.9, "bbox": [10, 10, 20, 20], "segmentation": {"size": [100, 100], "counts": masks.to_text(masks.from_box(10, 10, 20, 20, 100, 100))}}]
    for name, data in (("gt", gt), ("dt", dt)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    for kind in ("bbox", "segm"):
        assert cli.main(["eval", str(tmp_path / "gt.json"), str(tmp_path / "dt.json"), "--iou-type", kind, "--json", str(tmp_path / "out.json")]) == 0
        assert json.loads((tmp_path / "out.json").read_text())["stats"]["AP_0.50:0.95_all_100"] == pytest.approx(1.0)
    assert "Average Precision" in capsys.readouterr().out


def test_panoptic_evaluator(spark):
    from pixelyard.plans.panoptic import Evaluator

    pairs, gt, dt = panoptic_case(spark, [[1, 1, 2, 2]], [[1, 1, 2, 3]], {1: 1, 2: 2}, {1: 1, 2: 2, 3: 2})
    kinds = spark.createDataFrame([(1, True), (2, False)], "category_id long, isthing boolean")
    out = Evaluator().evaluate(kinds, gt, dt, pairs)
    assert out.to_dict()["things"]["pq"] == 1.0 and "n" not in out.to_dict(strict=True)["all"]
    assert Evaluator(things=(2,)).evaluate(kinds, gt, dt, pairs).to_dict()["stuff"]["pq"] == 1.0
    images = gt.select("image_id").distinct()
    man = spark.createDataFrame([(1, "sun")], "key long, w string")
    assert {(r["axis"], r["label"]) for r in out.sliced(man, images).collect()} == {(a, x) for a in ("w", "overall") for x in ("all", "things", "stuff")}
    with pytest.raises(UnknownImage):
        Evaluator().evaluate(kinds, gt, dt.where("false"), pairs)


def test_semantic_evaluator(spark, tmp_path):
    from pixelyard.plans.semantic import Evaluator

    for side, value in (("g", 1), ("d", 0)):
        (tmp_path / side).mkdir()
        (tmp_path / side / "a.png").write_bytes(write_png(np.array([[[0], [1], [255]], [[1], [value], [0]]], np.uint8), 2))
    out = Evaluator(2, 255).from_pngs(spark, str(tmp_path / "g"), str(tmp_path / "d"))
    assert {(r["gt_class"], r["dt_class"]): r["n"] for r in out.confusion().collect()} == {(0, 0): 2, (1, 1): 2, (1, 0): 1}
    assert out.summary().first()["pixel_accuracy"] == pytest.approx(0.8)
    assert Evaluator.preset("cityscapes").n_classes == 19 and Evaluator(2, 255, class_ids=(0,)).evaluate(out.runs).summary().first()["miou"] == pytest.approx(2 / 3)


def test_boundary_panoptic(spark):
    from pixelyard.errors import InvalidConfig
    from pixelyard.plans.panoptic import Evaluator

    gt_map, dt_map = np.zeros((40, 40), dtype=np.int64), np.zeros((40, 40), dtype=np.int64)
    gt_map[2:30, 2:30], gt_map[32:38, 2:38], dt_map[2:30, 4:32], dt_map[32:38, 2:38] = 1, 2, 7, 8
    rows = lambda m: spark.createDataFrame([(1, int(s), int(n), int(k)) for s, n, k in zip(*png.runs(m), strict=True)], "image_id long, start long, len long, segment_id long")
    gt = spark.createDataFrame([(1, 1, 1, 0, False), (1, 2, 2, 0, False)], "image_id long, segment_id long, category_id long, area long, iscrowd boolean")
    dt = spark.createDataFrame([(1, 7, 1, 0), (1, 8, 2, 0)], "image_id long, segment_id long, category_id long, area long")
    kinds = spark.createDataFrame([(1, True), (2, False)], "category_id long, isthing boolean")
    sizes = spark.createDataFrame([(1, 40, 40)], "image_id long, height int, width int")
    for mode in ("corrected", "strict"):
        evaluator = Evaluator(boundary=True, mode=mode, threshold=0.2)
        got = {r["category_id"]: r for r in evaluator.from_runs(kinds, gt, dt, rows(gt_map), rows(dt_map), sizes).per_class().collect()}
        (g, g_area), (d, d_area) = (panoptic.band_map(m, ids, 1, mode) for m, ids in ((gt_map, [1, 2]), (dt_map, [7, 8])))
        inter, void = int(((g == 1) & (d == 7)).sum()), int(((g == 0) & (d == 7)).sum())
        mask = ((gt_map == 1) & (dt_map == 7)).sum() / ((gt_map == 1).sum())
        edge = inter / (g_area[1] + d_area[7] - inter - void)
        assert edge < mask and got[1]["sq"] == pytest.approx(edge) and got[2]["pq"] == 1.0
    assert Evaluator().from_runs(kinds, gt, dt, rows(gt_map), rows(dt_map)).per_class().where("category_id = 1").first()["sq"] == pytest.approx(mask)
    with pytest.raises(InvalidConfig):
        Evaluator(boundary=True).from_runs(kinds, gt, dt, rows(gt_map), rows(dt_map))
    one, found = panoptic.band_map(np.ones((5, 5), dtype=np.int64), [1], 1)
    assert (one[1:4, 1:4] == panoptic.INTERIOR).all() and found == {1: 16}
