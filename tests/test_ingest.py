"""Each entry gives the detections and the ground truth that the file readers give."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from pixelyard.errors import InvalidConfig, InvalidDetection
from pixelyard.plans.instance import Evaluator
from pixelyard.plans.params import Segm
from pixelyard.sources import coco, ingest

RNG = random.Random(7)
DETS = [{"image_id": 1 + i // 5, "category_id": 1 + i % 3, "bbox": [float(RNG.randint(0, 50)) for _ in range(2)] + [float(RNG.randint(1, 50)) for _ in range(2)], "score": RNG.random()} for i in range(20)]


def plain(rows):
    got = coco.detections(rows).orderBy("ord").select("dt_id", "image_id", "category_id", "score", "bbox.*", "area").collect()
    return [tuple(r) for r in got]


def test_entries_agree(spark):
    expected = plain(ingest.records(spark, DETS))
    assert [r[0] for r in expected] == list(range(1, 21)) and expected[3][3] == DETS[3]["score"]
    table = np.array([[d["image_id"], *d["bbox"], d["score"], d["category_id"]] for d in DETS])
    assert plain(ingest.from_matrix(spark, table)) == expected
    boxes, scores, labels, images = table[:, 1:5], table[:, 5], table[:, 6], table[:, 0]
    corners = np.concatenate([boxes[:, :2], boxes[:, :2] + boxes[:, 2:]], axis=1)
    centres = np.concatenate([boxes[:, :2] + boxes[:, 2:] / 2, boxes[:, 2:]], axis=1)
    for fmt, b in (("xywh", boxes), ("xyxy", corners), ("cxcywh", centres)):
        by_image = [{"image_id": i, "boxes": b[images == i], "scores": scores[images == i], "labels": labels[images == i]} for i in (1, 2, 3, 4)]
        assert plain(ingest.from_images(spark, by_image, fmt)) == expected
        assert plain(ingest.from_batch(spark, images, b, scores, labels, box_format=fmt)) == expected
        assert plain(ingest.from_batch(spark, [1, 2, 3, 4], b, scores, labels, counts=[5, 5, 5, 5], box_format=fmt)) == expected
    assert plain(ingest.from_images(spark, {"image_id": 9, "boxes": np.zeros((0, 4)), "scores": [], "labels": []})) == []


def test_entries_refuse(spark):
    with pytest.raises(Exception, match="whole number"):
        ingest.from_matrix(spark, [[1.5, 0, 0, 1, 1, 0.5, 1]]).collect()
    with pytest.raises(InvalidDetection, match="whole"):
        ingest.from_batch(spark, [1], [[0, 0, 1, 1]], [0.5], [1.5])
    with pytest.raises(Exception, match="length"):
        ingest.from_batch(spark, [1, 1], [[0, 0, 1, 1]], [0.5], [1]).collect()
    with pytest.raises(Exception, match="counts"):
        ingest.from_batch(spark, [1], [[0, 0, 1, 1]], [0.5], [1], counts=[-1]).collect()
    with pytest.raises(Exception, match="2 \\*\\* 25"):
        coco.detections(ingest.records(spark, [DETS[0] | {"keypoints": [1e9, 0, 1]}])).collect()


def test_columns_round_trip_through_a_document(spark, tmp_path):
    data = ingest.ground_truth(spark, {"id": [1, 2], "width": [60, 60], "height": [50, 50]}, {"id": [1, 2, 3], "name": ["a", "b", "c"]}, {"id": [7, 8], "image_id": [1, 2], "category_id": [1, 3], "bbox": [[0, 0, 10, 10], [5, 5, 20, 20]], "iscrowd": [0, 1], "segmentation": [[[0, 0, 0, 10, 10, 10, 10, 0]], {"size": [50, 60], "counts": [0, 3000]}]}, masks=True)
    document = ingest.to_coco_json(data)
    (tmp_path / "gt.json").write_text(json.dumps(document))
    again = coco.check(coco.read_ground_truth(spark, str(tmp_path / "gt.json"), masks=True))
    assert again.digest() == data.digest() and ingest.to_coco_json(again) == document
    assert data.digest() != coco.Dataset(data.images, data.categories, data.gt.unionByName(data.gt)).digest()
    sizes = spark.createDataFrame([(1, None, None, None, None, None)], coco.IMAGE)
    anns = spark.createDataFrame([(1, '{"size": [50, 60], "counts": "x"}'), (1, None)], "image_id long, segmentation string")
    assert ingest.with_mask_image_sizes(sizes, anns).select("height", "width").first() == (50, 60)
    assert ingest.with_placeholder_image_sizes(sizes).first()["width"] == 1


def test_samples(spark):
    raster = np.zeros((1, 40, 40), dtype=np.uint8)
    raster[0, 5:15, 5:25] = 1
    target = {"boxes": [[5, 5, 25, 15]], "labels": [2], "masks": raster, "area": [0.0]}
    guess = {"boxes": [[5, 5, 25, 15]], "scores": [0.9], "labels": [2], "masks": raster}
    data, dt = ingest.coco_inputs(spark, [guess, guess | {"labels": [5]}], [target, target], "xyxy")
    assert [r["category_id"] for r in data.categories.orderBy("category_id").collect()] == [2, 5]
    assert data.images.where("height = 40 and width = 40").count() == 2 and data.gt.first()["area"] == 200.0
    assert Evaluator().evaluate(data, dt).metrics()["mar_100"] == pytest.approx(0.5)
    assert Evaluator(Segm()).evaluate(data, dt).metrics()["map_50"] == pytest.approx(0.5049504950495, abs=1e-6)
    columns = lambda *rows: {k: np.concatenate([np.asarray(r[k]) for r in rows]) for k in rows[0]} | {"counts": [1, 1]}
    other, dt2 = ingest.coco_inputs_from_columns(spark, columns(guess, guess | {"labels": [5]}), columns(target, target), box_format="xyxy")
    assert other.digest() == data.digest() and dt2.count() == 2
    with pytest.raises(InvalidConfig):
        ingest.coco_inputs(spark, [guess], [])
    with pytest.raises(InvalidConfig):
        ingest.coco_inputs(spark, [guess], [target | {"masks": None}], "xyxy", area="mask")
