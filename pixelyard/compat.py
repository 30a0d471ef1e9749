"""An evaluator in the customary shape: ``params``, ``evaluate``, ``accumulate``, ``summarize``, ``stats``.

The arrays it leaves (``eval``, ``evalImgs``, ``ious``) are the driver's, as large as the grid that is asked
for; ``plans.instance`` has the same as DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.errors import InvalidConfig
from pixelyard.operators import curves
from pixelyard.plans.instance import Evaluator, Result
from pixelyard.plans.params import AREAS, KEYPOINT_AREAS, Area, Bbox, Boundary, Keypoints, Params, Segm
from pixelyard.sources.coco import Dataset

KERNELS = {"bbox": Bbox(), "segm": Segm(), "boundary": Boundary(), "keypoints": Keypoints()}


@dataclass
class COCOParams:
    iouType: str = "bbox"
    imgIds: list[int] = field(default_factory=list)
    catIds: list[int] = field(default_factory=list)
    iouThrs: np.ndarray = field(default_factory=lambda: np.linspace(0.5, 0.95, 10))
    recThrs: np.ndarray = field(default_factory=lambda: np.linspace(0.0, 1.0, 101))
    maxDets: list[int] = field(default_factory=list)
    areaRng: list[list[float]] = field(default_factory=list)
    areaRngLbl: list[str] = field(default_factory=list)
    useCats: int = 1

    def __post_init__(self) -> None:
        keypoints = self.iouType == "keypoints"
        areas = KEYPOINT_AREAS if keypoints else AREAS
        self.maxDets = self.maxDets or ([20] if keypoints else [1, 10, 100])
        self.areaRng = self.areaRng or [[a.lo, a.hi] for a in areas]
        self.areaRngLbl = self.areaRngLbl or [a.label for a in areas]


class COCOeval:
    """``cocoGt``: a ``Dataset``; ``cocoDt``: detections. Empty ``imgIds`` or ``catIds`` mean all."""

    def __init__(self, cocoGt: Dataset, cocoDt: DataFrame, iouType: str = "segm"):
        if iouType not in KERNELS:
            raise InvalidConfig(f"unknown iouType {iouType!r}")
        self.cocoGt, self.cocoDt, self.params = cocoGt, cocoDt, COCOParams(iouType)
        self.eval: dict = {}
        self.stats: list[float] = []
        self._result: Result | None = None

    def evaluate(self) -> None:
        p = self.params
        if len(p.areaRng) != len(p.areaRngLbl):
            raise InvalidConfig("areaRng and areaRngLbl differ in length")
        data, dt = self.cocoGt, self.cocoDt
        if p.imgIds:
            some = lambda df: df.where(F.col("image_id").isin([int(i) for i in p.imgIds]))
            data, dt = Dataset(some(data.images), data.categories, some(data.gt)), some(dt)
        if p.catIds:
            some = lambda df: df.where(F.col("category_id").isin([int(i) for i in p.catIds]))
            data, dt = Dataset(data.images, some(data.categories), some(data.gt)), some(dt)
        areas = tuple(Area(label, float(lo), float(hi)) for label, (lo, hi) in zip(p.areaRngLbl, p.areaRng, strict=True))
        params = Params(tuple(map(float, p.iouThrs)), tuple(map(float, p.recThrs)), tuple(p.maxDets), areas, bool(p.useCats), "strict")
        self._result = Evaluator(KERNELS[p.iouType], params).evaluate_tables(data, dt)

    def _found(self) -> Result:
        if self._result is None:
            raise InvalidConfig("evaluate() comes first")
        return self._result

    @property
    def ious(self) -> dict[tuple[int, int], np.ndarray]:
        return {(r["image_id"], r["category_id"]): np.array(r["ious"]) for r in self._found().ious().collect()}

    @property
    def evalImgs(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self._found().eval_imgs().collect()]

    def accumulate(self) -> None:
        """``eval['precision']`` and ``['scores']`` by threshold, recall, category, area and cap, ``['recall']`` without the recall axis; -1 stands for no value."""
        r, p = self._found(), self._found().params
        categories = [-1] if not p.use_cats else sorted(x["category_id"] for x in r.data.categories.select("category_id").collect())
        at = {c: i for i, c in enumerate(categories)}
        shape = (len(p.iou_thresholds), len(p.recall_thresholds), len(categories), len(p.areas), len(p.max_dets))
        precision, scores, recall = np.full(shape, -1.0), np.full(shape, -1.0), np.full(shape[:1] + shape[2:], -1.0)
        pr, _ = r.curves()
        for x in curves.dense(pr, r.npig, p).where("precision is not null").collect():
            place = (x["t_idx"], x["r_idx"], at[x["category_id"]], x["area_idx"], x["m_idx"])
            precision[place], scores[place] = x["precision"], x["score"]
        for x in r.values().collect():
            recall[x["t_idx"], at[x["category_id"]], x["area_idx"], x["m_idx"]] = x["ar"]
        self.eval = {"params": self.params, "counts": list(shape), "precision": precision, "recall": recall, "scores": scores}

    def summarize(self) -> None:
        """Print and keep the customary lines; a custom grid needs the areas and caps that they name."""
        if not self.eval:
            raise InvalidConfig("accumulate() comes first")
        r = self._found()
        self.stats = r.stats()
        print("\n".join(r.text()))
