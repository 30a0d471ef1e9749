"""Detections and ground truth as callers hold them: arrays by image, whole batches, matrices, records.

Every entry ends in the rows that ``coco.detections`` and ``coco.ground_truth`` take. Where the values are
already in a table, DataFrame functions reshape them; arrays on the driver become a table first.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelyard.errors import InvalidAnnotation, InvalidConfig, InvalidDetection
from pixelyard.functions.geometry import box_from
from pixelyard.operators import masks
from pixelyard.sources import coco

MOST_EXACT = 2**53
#: The columns of a matrix of detections, in order.
MATRIX = ("image_id", "x", "y", "w", "h", "score", "category_id")
AREA_POLICIES = ("auto", "supplied", "box", "mask")


def _checked(condition: Column, message: str, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def _rows(flat: DataFrame, box_format: str, given: Sequence[str]) -> DataFrame:
    """Result rows of ``image_id, boxes, scores, labels, ..``, one value a row."""
    b = box_from(F.col("boxes"), box_format)
    out = flat.select(
        F.lit(None).cast("long").alias("id"),
        F.col("image_id").cast("long").alias("image_id"),
        F.col("labels").cast("long").alias("category_id"),
        F.col("scores").cast("double").alias("score"),
        F.array(*[b[k] for k in "xywh"]).alias("bbox"),
        F.lit(None).cast("double").alias("area"),
        (F.col("masks") if "masks" in given else F.lit(None)).cast("string").alias("segmentation"),
        (F.col("keypoints") if "keypoints" in given else F.lit(None)).cast("array<double>").alias("keypoints"),
        F.lit(None).cast("int").alias("num_keypoints"),
    )
    return out.withColumn("ord", F.monotonically_increasing_id())


def per_image(images: DataFrame, box_format: str = "xywh") -> DataFrame:
    """Result rows of a row an image: ``image_id`` and the arrays ``boxes``, ``scores``, ``labels`` (also ``masks``, JSON texts, and ``keypoints``) of one length."""
    given = [c for c in ("boxes", "scores", "labels", "masks", "keypoints") if c in images.columns]
    if not {"boxes", "scores", "labels"} <= set(given):
        raise InvalidDetection("boxes, scores and labels are needed")
    alike = F.forall(F.array(*[F.size(c) for c in given]), lambda n: n == F.size("boxes"))
    zipped = _checked(alike, "an image's columns disagree in length", F.arrays_zip(*given))
    return _rows(images.select("image_id", F.explode(zipped).alias("x")).select("image_id", "x.*"), box_format, given)


def batch(batches: DataFrame, box_format: str = "xywh") -> DataFrame:
    """Result rows of a row a batch: arrays as in ``per_image``, and ``image_ids`` by detection, or by image beside ``counts``."""
    ids = F.col("image_ids")
    if "counts" in batches.columns:
        fits = (F.size("counts") == F.size(ids)) & ~F.exists("counts", lambda n: n < 0)
        pairs = _checked(fits, "counts don't fit image_ids", F.arrays_zip(ids.alias("i"), F.col("counts").alias("n")))
        ids = F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["i"], p["n"].cast("int"))))
    given = [c for c in ("boxes", "scores", "labels", "masks", "keypoints") if c in batches.columns]
    wide = batches.withColumn("image_id", ids)
    alike = F.forall(F.array(*[F.size(c) for c in given]), lambda n: n == F.size("image_id"))
    zipped = _checked(alike, "a batch's columns disagree in length", F.arrays_zip("image_id", *given))
    return _rows(wide.select(F.explode(zipped).alias("x")).select("x.*"), box_format, given)


def matrix(rows: DataFrame) -> DataFrame:
    """Result rows of seven number columns in the order of ``MATRIX``; ids must be whole and at most 2 ** 53."""
    if len(rows.columns) != len(MATRIX):
        raise InvalidDetection(f"a matrix has the columns {', '.join(MATRIX)}")
    named = rows.toDF(*MATRIX)
    whole = lambda c: _checked((F.col(c) == F.floor(c)) & (F.abs(c) <= MOST_EXACT), f"{c} isn't a whole number of at most 2 ** 53", F.col(c)).cast("long")
    flat = named.select(whole("image_id").alias("image_id"), F.array("x", "y", "w", "h").alias("boxes"), F.col("score").alias("scores"), whole("category_id").alias("labels"))
    return _rows(flat, "xywh", ())


def _json(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def records(spark: SparkSession, results: Sequence[Mapping]) -> DataFrame:
    """Result rows of dictionaries in the shape of a results file."""
    numbers = lambda v: None if v is None else [float(x) for x in v]
    rows = [
        (r.get("id"), int(r["image_id"]), int(r["category_id"]), float(r["score"]), numbers(r.get("bbox")), r.get("area"), _json(r.get("segmentation")), numbers(r.get("keypoints")), r.get("num_keypoints"), i)
        for i, r in enumerate(results)
    ]
    return spark.createDataFrame(rows, coco.DETECTION + ", ord long")


def _floats(values, shape: int | None = None) -> np.ndarray:
    out = np.ascontiguousarray(getattr(getattr(values, "detach", lambda: values)(), "cpu", lambda: values)(), dtype=np.float64)
    return out.reshape(-1, shape) if shape else out


def _whole(values) -> np.ndarray:
    out = _floats(values)
    if len(out) and not (np.isfinite(out).all() and (out == np.floor(out)).all() and (np.abs(out) <= MOST_EXACT).all()):
        raise InvalidDetection("labels and ids are whole numbers")
    return out.astype(np.int64)


def from_matrix(spark: SparkSession, values) -> DataFrame:
    """Result rows of an (N, 7) array."""
    return matrix(spark.createDataFrame(pa.table(list(_floats(values, len(MATRIX)).T), names=list(MATRIX))))


def from_images(spark: SparkSession, images: Mapping | Sequence[Mapping], box_format: str = "xywh") -> DataFrame:
    """Result rows of a dictionary (or several) an image: ``image_id``, ``boxes``, ``scores``, ``labels``, and maybe ``masks`` or ``keypoints``."""
    images = [images] if isinstance(images, Mapping) else list(images)
    rows = [(int(d["image_id"]), _floats(d["boxes"], 4).tolist(), _floats(d["scores"]).tolist(), _whole(d["labels"]).tolist(), [_json(_rle(m)) for m in d["masks"]] if "masks" in d else None, _floats(d["keypoints"]).reshape(len(d["boxes"]), -1).tolist() if "keypoints" in d else None) for d in images]
    table = spark.createDataFrame(rows, "image_id long, boxes array<array<double>>, scores array<double>, labels array<long>, masks array<string>, keypoints array<array<double>>")
    return per_image(table.drop(*[c for c in ("masks", "keypoints") if not any(c in d for d in images)]), box_format)


def from_batch(spark: SparkSession, image_ids, boxes, scores, labels, counts=None, box_format: str = "xywh") -> DataFrame:
    """Result rows of concatenated arrays."""
    row = (_whole(image_ids).tolist(), _floats(boxes, 4).tolist(), _floats(scores).tolist(), _whole(labels).tolist(), None if counts is None else _whole(counts).tolist())
    table = spark.createDataFrame([row], "image_ids array<long>, boxes array<array<double>>, scores array<double>, labels array<long>, counts array<long>")
    return batch(table if counts is not None else table.drop("counts"), box_format)


def _rle(mask):
    """A mask as run lengths with their size: those, or a raster."""
    if mask is None or isinstance(mask, (str, Mapping, list)):
        return mask
    raster = np.asarray(mask)
    return {"size": list(raster.shape), "counts": masks.encode(raster).tolist()}


def _table(spark: SparkSession, columns: Mapping, schema: str, names: Sequence[str]) -> DataFrame:
    sizes = {len(v) for v in columns.values()}
    if len(sizes) > 1:
        raise InvalidAnnotation("columns disagree in length")
    n = sizes.pop() if sizes else 0
    fields = T._parse_datatype_string(schema).fields
    cells = [[_cell(v, f.dataType) for v in columns[f.name]] if f.name in columns else [None] * n for f in fields]
    return spark.createDataFrame(list(zip(*cells, strict=True)), schema).select(*names)


def _cell(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_cell(v, kind.elementType) for v in value]
    if isinstance(kind, T.StringType):
        return _json(value) if not isinstance(value, (bool, int, np.bool_, np.integer)) else str(int(value))
    return float(value) if isinstance(kind, T.DoubleType) else int(value)


def ground_truth(spark: SparkSession, images: Mapping, categories: Mapping, annotations: Mapping, masks: bool = False) -> coco.Dataset:
    """A dataset of columns by name, as in a ground truth file."""
    names = lambda schema: [f.name for f in T._parse_datatype_string(schema).fields]
    anns = dict(annotations) | {"ord": range(len(annotations["id"]))}
    tables = [_table(spark, c, s, names(s)) for c, s in ((images, coco.IMAGE), (categories, coco.CATEGORY), (anns, coco.ANNOTATION + ", ord long"))]
    return coco.check(coco.ground_truth(tables[0], tables[1], tables[2], masks))


# ----------------------------------------------------------------- inference


def with_mask_image_sizes(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """``images`` with missing sizes filled from the run-length masks of ``annotations(image_id, segmentation)``."""
    size = lambda i: F.get_json_object("segmentation", f"$.size[{i}]").cast("int")
    found = annotations.groupBy("image_id").agg(F.max(size(0)).alias("_h"), F.max(size(1)).alias("_w"))
    filled = images.join(found.withColumnRenamed("image_id", "id"), "id", "left").withColumns({"height": F.coalesce("height", "_h"), "width": F.coalesce("width", "_w")})
    return filled.select(*images.columns)


def with_placeholder_image_sizes(images: DataFrame, size: int = 1) -> DataFrame:
    """``images`` with missing sizes set: box kernels never look at them."""
    return images.na.fill(size, ["height", "width"])


def infer_categories(*labelled: DataFrame) -> DataFrame:
    """Categories of all ``category_id`` of some tables, named by their ids, ascending."""
    ids = labelled[0].select("category_id")
    for other in labelled[1:]:
        ids = ids.unionByName(other.select("category_id"))
    blank = [F.lit(None).cast("string").alias(c) for c in ("supercategory", "frequency", "isthing")]
    return ids.distinct().orderBy("category_id").select(F.col("category_id").alias("id"), F.col("category_id").cast("string").alias("name"), *blank)


# ------------------------------------------------------------------- samples


def coco_inputs(spark: SparkSession, predictions: Sequence[Mapping], targets: Sequence[Mapping], box_format: str = "xywh", categories: Sequence[int] | None = None, area: str = "auto") -> tuple[coco.Dataset, DataFrame]:
    """A dataset and detections from a trainer's records, one pair an image.

    ``targets[i]``: ``boxes, labels`` and maybe ``iscrowd, area, masks, image_id``; ``predictions[i]``: ``boxes,
    scores, labels`` and maybe ``masks, image_id``. Masks are rasters or run lengths; where all records
    have them the inputs serve mask kernels too. Sizes come from the targets' masks, else from the
    predictions'. ``area``: ``auto`` takes a given positive area, else the mask's, else the box's.
    """
    if len(predictions) != len(targets):
        raise InvalidConfig("predictions and targets differ in length")
    if area not in AREA_POLICIES:
        raise InvalidConfig(f"unknown area policy {area!r}")
    images, anns, dets, seen = [], [], [], set()
    for i, (p, t) in enumerate(zip(predictions, targets, strict=True)):
        image_id = int(t.get("image_id", i))
        if int(p.get("image_id", image_id)) != image_id:
            raise InvalidConfig(f"record {i}: predictions and targets are of different images")
        shapes = {k: [_rle(m) for m in side["masks"]] if side.get("masks") is not None else None for k, side in (("t", t), ("p", p))}
        size = next((m["size"] for side in ("t", "p") for m in shapes[side] or () if isinstance(m, Mapping)), None)
        images.append((image_id, *(reversed([int(x) for x in size]) if size else (None, None)), None, None, None))
        boxes, labels = _boxes(t["boxes"], box_format), _whole(t["labels"])
        given = _floats(t["area"]) if t.get("area") is not None else None
        crowd = _whole(t["iscrowd"]) if t.get("iscrowd") is not None else np.zeros(len(labels), dtype=np.int64)
        _same(i, len(labels), boxes, crowd, *(x for x in (given, shapes["t"]) if x is not None))
        for j, label in enumerate(labels.tolist()):
            mask = shapes["t"][j] if shapes["t"] else None
            anns.append((len(anns) + 1, image_id, label, _area(area, given, j, mask, boxes[j]), str(int(crowd[j])), None, boxes[j].tolist(), _json(mask), None, None, len(anns)))
        boxes, scores, labels_p = _boxes(p["boxes"], box_format), _floats(p["scores"]), _whole(p["labels"])
        _same(i, len(labels_p), boxes, scores, *((shapes["p"],) if shapes["p"] is not None else ()))
        dets += [(None, image_id, label, float(scores[j]), boxes[j].tolist(), None, _json(shapes["p"][j]) if shapes["p"] else None, None, None, len(dets) + j) for j, label in enumerate(labels_p.tolist())]
        seen |= {*labels.tolist(), *labels_p.tolist()}
    known = sorted(seen if categories is None else {int(c) for c in categories})
    with_masks = bool(anns or dets) and all(a[7] for a in anns) and all(d[6] for d in dets)
    data = coco.ground_truth(spark.createDataFrame(images, coco.IMAGE), spark.createDataFrame([(c, str(c), None, None, None) for c in known], coco.CATEGORY), spark.createDataFrame(anns, coco.ANNOTATION + ", ord long"), with_masks)
    return coco.check(data), coco.detections(spark.createDataFrame(dets, coco.DETECTION + ", ord long"), images=data.images, masks=with_masks)


def coco_inputs_from_columns(spark: SparkSession, detections: Mapping, targets: Mapping, image_ids: Sequence[int] | None = None, **options) -> tuple[coco.Dataset, DataFrame]:
    """``coco_inputs`` of concatenated columns whose ``counts`` give each image's rows."""

    def split(columns: Mapping) -> list[dict]:
        counts = _whole(columns["counts"])
        ends = np.cumsum(counts)
        if (counts < 0).any() or any(len(v) != counts.sum() for k, v in columns.items() if k != "counts" and v is not None):
            raise InvalidConfig("counts don't fit the columns")
        return [{k: v[e - n : e] for k, v in columns.items() if k != "counts" and v is not None} for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]

    p, t = split(detections), split(targets)
    for i, image in enumerate(image_ids if image_ids is not None else ()):
        p[i]["image_id"] = t[i]["image_id"] = int(image)
    return coco_inputs(spark, p, t, **options)


def _boxes(values, fmt: str) -> np.ndarray:
    b = _floats(values, 4).copy()
    if fmt == "xyxy":
        b[:, 2:] -= b[:, :2]
    elif fmt == "cxcywh":
        b[:, :2] -= b[:, 2:] / 2
    elif fmt != "xywh":
        raise InvalidConfig(f"unknown box format {fmt!r}")
    return b


def _same(record: int, n: int, *columns) -> None:
    if any(len(c) != n for c in columns):
        raise InvalidConfig(f"record {record}: columns disagree in length")


def _area(policy: str, given: np.ndarray | None, j: int, mask, box: np.ndarray) -> float:
    if policy == "supplied" or (policy == "auto" and given is not None and given[j] > 0):
        if given is None:
            raise InvalidConfig("no areas are supplied")
        return float(given[j])
    if policy != "box" and isinstance(mask, Mapping):
        counts = mask["counts"]
        return float(masks.area(masks.from_text(counts) if isinstance(counts, str) else counts))
    if policy == "mask":
        raise InvalidConfig("a target has no mask")
    return float(box[2] * box[3])


def to_coco_json(data: coco.Dataset) -> dict:
    """The dataset as a ground truth document: for tools that read files, so it is as large as one."""
    gt = data.gt.orderBy("ord")
    rows = lambda df: [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.collect()]
    anns = rows(gt.select(F.col("ann_id").alias("id"), "image_id", "category_id", "area", F.col("iscrowd").cast("int").alias("iscrowd"), F.col("ignore").cast("int").alias("ignore"), F.array(*[F.col(f"bbox.{k}") for k in "xywh"]).alias("bbox"), *[c for c in ("keypoints", "num_keypoints", "mask") if c in gt.columns]))
    for a in anns:
        if "mask" in a:
            m = a.pop("mask")
            if m.get("counts") is not None:
                a["segmentation"] = {"size": [m["h"], m["w"]], "counts": masks.to_text(m["counts"])}
    return {"images": rows(data.images.withColumnRenamed("image_id", "id")), "categories": rows(data.categories.withColumnRenamed("category_id", "id")), "annotations": anns}
