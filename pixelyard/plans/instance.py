"""The instance paradigm: detections, masks, boundaries and keypoints against ground truth."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.errors import IncompatibleSummaryPlan, InvalidConfig
from pixelyard.functions.numeric import pairwise_mean
from pixelyard.operators import calibration, curves, diagnostics, federated, matching, slices, summary, tables
from pixelyard.operators.masks import with_bands
from pixelyard.operators.similarity import of_kernel
from pixelyard.plans.params import KEYPOINT_AREAS, Bbox, Boundary, ByFrequency, ByGroup, ByIds, Keypoints, Params, coco_plan, keypoint_plan, lvis_plan
from pixelyard.sources.coco import Dataset


@dataclass
class Result:
    """What an evaluation leaves: ``matches``, ground truth counts, and what is derived from them."""

    data: Dataset
    gt: DataFrame
    dt: DataFrame
    matches: DataFrame
    npig: DataFrame
    params: Params
    plan: tuple
    pairs_of: object = None
    _values: DataFrame | None = field(default=None, repr=False)

    def curves(self) -> tuple[DataFrame, DataFrame]:
        return curves.curve(self.matches, self.npig, self.params)

    def values(self) -> DataFrame:
        if self._values is None:
            self._values = curves.lane_values(self.matches, self.npig, self.params)
        return self._values

    def summary(self, categories: ByFrequency | ByIds | ByGroup | None = None, groups: DataFrame | None = None) -> DataFrame:
        """The summary over all categories, or over those of a filter; an empty choice has no values."""
        return summary.lines(self._chosen(categories, groups), self.params, self.plan, self.data.categories)

    def _chosen(self, categories, groups: DataFrame | None) -> DataFrame:
        values = self.values()
        if categories is None:
            return values
        if isinstance(categories, ByIds):
            return values.where(F.col("category_id").isin([int(i) for i in categories.ids]))
        if isinstance(categories, ByFrequency):
            return values.join(self.data.categories.where(F.col("frequency") == categories.tag).select("category_id"), "category_id", "left_semi")
        if groups is None or not groups.where(F.col("label") == categories.label).take(1):
            raise InvalidConfig(f"no group is called {categories.label!r}")
        return values.join(groups.where(F.col("label") == categories.label).select("category_id"), "category_id", "left_semi")

    def by_group(self, groups: DataFrame) -> DataFrame:
        """The summary by group of ``groups(label, category_id)``; a category may be in several."""
        return summary.lines(self.values().join(groups.select("label", "category_id").distinct(), "category_id"), self.params, self.plan, self.data.categories, ["label"])

    def ious(self) -> DataFrame:
        """``image_id, category_id, dts, gts, ious``: a row a cell with both, its overlaps by detection (in order of rank) and ground truth."""
        every = self.pairs(0.0)
        ranked = self.dt.select("dt_id", "rank")
        cell = every.join(ranked, "dt_id").join(self.gt.select("ann_id", F.col("ord").alias("g_ord")), "ann_id")
        rows = cell.groupBy("image_id", "category_id", "rank", "dt_id").agg(F.array_sort(F.collect_list(F.struct("g_ord", "ann_id", "iou"))).alias("g"))
        cells = rows.groupBy("image_id", "category_id").agg(F.array_sort(F.collect_list(F.struct("rank", "dt_id", "g"))).alias("x"))
        return cells.select("image_id", "category_id", F.col("x.dt_id").alias("dts"), F.col("x")[0]["g"]["ann_id"].alias("gts"), F.transform("x", lambda d: d["g"]["iou"]).alias("ious"))

    def stats(self) -> list[float]:
        """The summary's values in order, -1 where there is none."""
        if self.params.mode == "strict":
            return self._strict_stats()
        return [-1.0 if r["value"] is None else r["value"] for r in self.summary().orderBy("ord").collect()]

    def _strict_stats(self) -> list[float]:
        """Means of the cube in (threshold, recall, category) order by pairwise sums."""
        pr, _ = self.curves()
        cube = curves.dense(pr, self.npig, self.params).where("precision is not null")
        lanes = self.values()
        frequency = {r["category_id"]: r["frequency"] for r in self.data.categories.collect()} if "frequency" in self.data.categories.columns else {}
        out = []
        for line in self.plan:
            cap = line.cap_index(self.params.max_dets)
            if cap is None:
                out.append(-1.0)
                continue
            here = (F.col("area_idx") == self.params.area_index(line.area)) & (F.col("m_idx") == cap)
            if line.iou is not None:
                here &= F.col("t_idx") == self.params.iou_index(line.iou)
            rows = (cube.where(here).orderBy("t_idx", "r_idx", "category_id").select("category_id", F.col("precision").alias("v")) if line.metric == "AP" else lanes.where(here).orderBy("t_idx", "category_id").select("category_id", F.col("ar").alias("v"))).collect()
            out.append(pairwise_mean([r["v"] for r in rows if line.frequency is None or frequency.get(r["category_id"]) == line.frequency]))
        return out

    def text(self) -> list[str]:
        return summary.text(self.summary())

    def per_class(self) -> DataFrame:
        n_gt = self.gt.groupBy("category_id").agg(F.count_if(~F.col("ign")).alias("n_gt"))
        n_dt = self.matches.groupBy("category_id").agg(F.count("*").alias("n_dt"))
        table = summary.per_class(self.values(), self.params)
        return table.join(n_gt, "category_id", "full").join(n_dt, "category_id", "full").na.fill(0, ["n_gt", "n_dt"])

    def per_image(self) -> DataFrame:
        return tables.per_image(self.data.images, self.gt, self.matches, self.params)

    def pairs(self, floor: float = tables.PAIR_FLOOR) -> DataFrame:
        return matching.pairs(self.gt, self.dt, floor, self.pairs_of)

    def per_pair(self, floor: float = tables.PAIR_FLOOR, cap: int = tables.PAIR_CAP) -> DataFrame:
        return tables.per_pair(self.pairs(floor), cap)

    def per_detection(self, geometry: bool = False) -> DataFrame:
        return tables.per_detection(self.matches, self.pairs(), self.params, self.dt if geometry else None)

    def eval_imgs(self) -> DataFrame:
        """A row a cell and area range, with the arrays that per-image consumers expect."""
        by_area = self.matches.select("image_id", "category_id", "dt_id", "score", "rank", F.posexplode(F.arrays_zip("matched", "ignored", "gts")).alias("area_idx", "x"))
        return by_area.groupBy("image_id", "category_id", "area_idx").agg(F.array_sort(F.collect_list(F.struct("rank", "dt_id", "score", "x"))).alias("dts"))

    def calibration(self, iou: float = 0.5, n_bins: int = 15, binning: str = "quantile", min_score: float = 0.05, per_class: bool = False, confidence: str = "wilson") -> tuple[DataFrame, DataFrame]:
        """Reliability bins and errors (by class if asked for)."""
        dets = calibration.scored(self.matches, self.params.iou_index(iou), min_score)
        bounds = calibration.edges(dets, n_bins, binning, min_score)
        bins = calibration.reliability(dets, bounds, confidence=confidence)
        by = ["category_id"] if per_class else None
        return bins, calibration.errors(calibration.reliability(dets, bounds, by, confidence), by)

    def sliced(self, manifest: DataFrame, cross: tuple = (), cap: int = slices.SLICE_CAP) -> DataFrame:
        """The summary by slice, and ``overall``; matched once."""
        parts = slices.with_overall(slices.slices(manifest, self.data.images, cross, cap), self.data.images)
        key = ["axis", "value"]
        ranges = F.array(*[F.struct(F.lit(i).alias("area_idx"), F.lit(a.lo).alias("lo"), F.lit(a.hi).alias("hi")) for i, a in enumerate(self.params.areas)])
        counting = slices.fan_out(self.gt, parts).select(*key, "category_id", "area", "ign", F.explode(ranges).alias("r"))
        npig = counting.groupBy(*key, "category_id", F.col("r.area_idx").alias("area_idx")).agg(F.count_if(~F.col("ign") & F.col("area").between(F.col("r.lo"), F.col("r.hi"))).alias("npig"))
        return summary.lines(curves.lane_values(slices.fan_out(self.matches, parts), npig, self.params, key), self.params, self.plan, self.data.categories, key)

    def metrics(self) -> dict[str, float]:
        """Flat names: ``map, map_50, ..`` and ``mar_<cap>``."""
        rows = self.values()
        last, n = len(self.params.max_dets) - 1, len(self.params.max_dets)
        known = {a.label: i for i, a in enumerate(self.params.areas)}
        here = (F.col("m_idx") == last) & (F.col("area_idx") == known["all"])
        parts = [F.avg(F.when(here, F.col("ap"))).alias("map")]
        for iou in (0.5, 0.75):
            if any(abs(t - iou) <= 1e-12 for t in self.params.iou_thresholds):
                parts.append(F.avg(F.when(here & (F.col("t_idx") == self.params.iou_index(iou)), F.col("ap"))).alias(f"map_{int(iou * 100)}"))
        for label in ("small", "medium", "large"):
            if label in known:
                at = (F.col("m_idx") == last) & (F.col("area_idx") == known[label])
                parts += [F.avg(F.when(at, F.col("ap"))).alias(f"map_{label}"), F.avg(F.when(at, F.col("ar"))).alias(f"mar_{label}")]
        parts += [F.avg(F.when((F.col("m_idx") == m) & (F.col("area_idx") == known["all"]), F.col("ar"))).alias(f"mar_{self.params.max_dets[m]}") for m in range(n)]
        row = rows.agg(*parts).first().asDict()
        return {k: -1.0 if v is None else v for k, v in row.items()}


@dataclass(frozen=True)
class Evaluator:
    """Scores detections against a ``Dataset``. DataFrames in, DataFrames out; nothing runs until asked for."""

    kernel: object = Bbox()
    params: Params = Params()

    def _params(self, federated_: bool) -> Params:
        params = self.params
        if isinstance(self.kernel, Keypoints) and params.max_dets == (1, 10, 100):
            params = params.but(max_dets=(20,), areas=KEYPOINT_AREAS)
        elif federated_ and params.max_dets == (1, 10, 100):
            params = params.but(max_dets=(300,))
        return params

    def _plan(self, params: Params, federated_: bool) -> tuple:
        return lvis_plan() if federated_ else keypoint_plan() if isinstance(self.kernel, Keypoints) else coco_plan(params.mode)

    def _sides(self, data: Dataset, dt: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
        gt = matching.effective_ignore(data.gt, params.mode, isinstance(self.kernel, Keypoints))
        dt = dt.join(data.images.select("image_id"), "image_id", "left_semi")
        if isinstance(self.kernel, Boundary):
            gt, dt = with_bands(gt, self.kernel.dilation_ratio), with_bands(dt, self.kernel.dilation_ratio)
        return matching.collapse_categories(gt, params.use_cats), matching.collapse_categories(dt, params.use_cats)

    def match(self, data: Dataset, dt: DataFrame) -> Result:
        fed = "frequency" in data.categories.columns and data.federated
        params = self._params(fed)
        gt, dt = self._sides(data, dt, params)
        score = of_kernel(self.kernel)
        if isinstance(self.kernel, Keypoints) and not params.use_cats and params.mode == "strict":
            score = lambda g, d: F.lit(0.0) * g["area"]
        if fed:
            negatives, open_cells = federated.from_images(data.images)
            gt, ranked = federated.prepare(gt, dt, negatives, params)
            matches = matching.match(gt, ranked, params, score, exhaustive=open_cells)
        else:
            ranked = matching.top_k(dt, params.max_dets[-1])
            matches = matching.match(gt, ranked, params, score)
        return Result(data, gt, ranked, matches, matching.ground_truth_counts(gt, params), params, self._plan(params, fed), score)

    def evaluate(self, data: Dataset, dt: DataFrame) -> Result:
        if not self.params.is_default_grid:
            raise IncompatibleSummaryPlan("a custom grid has no default summary; use evaluate_tables")
        return self.match(data, dt)

    def evaluate_tables(self, data: Dataset, dt: DataFrame) -> Result:
        return self.match(data, dt)

    def _diagnosed(self, data: Dataset, dt: DataFrame) -> tuple[DataFrame, DataFrame]:
        diagnostics.refuse_federated("frequency" in data.categories.columns and data.federated)
        if isinstance(self.kernel, Keypoints):
            raise InvalidConfig("not defined for keypoints")
        gt, dt = self._sides(data, dt, self.params)
        return gt.withColumn("ign", F.coalesce("iscrowd", F.lit(False)) | F.coalesce("ignore", F.lit(False))), dt

    def error_decomposition(self, data: Dataset, dt: DataFrame, max_dets: int = 100) -> DataFrame:
        return diagnostics.error_decomposition(*self._diagnosed(data, dt), self.params, *diagnostics.TIDE_THRESHOLDS[self.kernel.name], max_dets, of_kernel(self.kernel))

    def confusion_matrix(self, data: Dataset, dt: DataFrame, t_f: float = 0.5, max_dets: int = 100) -> DataFrame:
        return diagnostics.confusion_matrix(*self._diagnosed(data, dt), t_f, max_dets, of_kernel(self.kernel))

    def tide_bins(self, data: Dataset, dt: DataFrame, max_dets: int = 100) -> tuple[DataFrame, DataFrame]:
        return diagnostics.tide_bins(*self._diagnosed(data, dt), *diagnostics.TIDE_THRESHOLDS[self.kernel.name], max_dets, of_kernel(self.kernel))

    def fp_iou_histogram(self, data: Dataset, dt: DataFrame, n_bins: int = 20) -> DataFrame:
        return diagnostics.fp_iou_histogram(self.tide_bins(data, dt)[0], n_bins)

    def sliced_lrp(self, data: Dataset, dt: DataFrame, manifest: DataFrame, cross: tuple = (), cap: int = slices.SLICE_CAP, tp_threshold: float = 0.5, tau_grid: tuple[float, ...] = diagnostics.TAU_GRID, max_dets: int = 100) -> tuple[DataFrame, DataFrame]:
        """``optimal_lrp`` by slice, and ``overall``: per class and the report's means; matched once."""
        diagnostics.refuse_federated("frequency" in data.categories.columns and data.federated)
        gt, dt = self._sides(data, dt, self.params)
        parts = slices.with_overall(slices.slices(manifest, data.images, cross, cap), data.images)
        key = ["axis", "value"]
        found = diagnostics.lrp_matches(gt, matching.top_k(dt, max_dets), tp_threshold, of_kernel(self.kernel))
        n_gt = diagnostics.n_counting(slices.fan_out(gt, parts), key)
        per_class = diagnostics.optimal_lrp(slices.fan_out(found, parts), n_gt, tp_threshold, tau_grid, key)
        return per_class, diagnostics.lrp_report(per_class, key)

    def optimal_lrp(self, data: Dataset, dt: DataFrame, tp_threshold: float = 0.5, tau_grid: tuple[float, ...] = diagnostics.TAU_GRID, max_dets: int = 100) -> tuple[DataFrame, DataFrame]:
        """Per class and the report's means."""
        diagnostics.refuse_federated("frequency" in data.categories.columns and data.federated)
        gt, dt = self._sides(data, dt, self.params)
        found = diagnostics.lrp_matches(gt, matching.top_k(dt, max_dets), tp_threshold, of_kernel(self.kernel))
        per_class = diagnostics.optimal_lrp(found, diagnostics.n_counting(gt), tp_threshold, tau_grid)
        return per_class, diagnostics.lrp_report(per_class)
