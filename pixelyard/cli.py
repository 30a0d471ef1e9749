"""Command line: ``eval`` and ``aggregate``. Exit codes: 0 done, 1 bad input, 2 bad usage."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from pathlib import Path

from pixelyard.errors import EvalError, InvalidConfig


def write_json(path: str, document: dict) -> None:
    """Keys in order, in one step: readers see the old file or the new one."""
    target = Path(path)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False) as out:
        json.dump(document, out, indent=2, sort_keys=True)
        out.write("\n")
    os.replace(out.name, target)


def read_sigmas(path: str) -> dict[int, tuple[float, ...]]:
    """``{category id: [sigma, ..]}``, all positive."""
    found = {int(k): tuple(float(x) for x in v) for k, v in json.loads(Path(path).read_text()).items()}
    if any(not v or min(v) <= 0 for v in found.values()):
        raise InvalidConfig("sigmas are positive")
    return found


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pixelyard")
    verbs = top.add_subparsers(dest="verb", required=True)
    ev = verbs.add_parser("eval", help="score detections against ground truth")
    ev.add_argument("gt")
    ev.add_argument("dt")
    ev.add_argument("--iou-type", choices=("bbox", "segm", "boundary", "keypoints"), default="bbox")
    ev.add_argument("--mode", choices=("strict", "corrected"), default="strict")
    ev.add_argument("--manifest")
    ev.add_argument("--cross", action="append", default=[], help="axes joined by commas")
    ev.add_argument("--max-dets", help="caps joined by commas")
    ev.add_argument("--iou-thresholds", help="thresholds joined by commas: tables only, without the customary lines")
    ev.add_argument("--no-cats", action="store_true", help="match across categories")
    ev.add_argument("--dilation-ratio", type=float, default=0.02, help="of boundaries")
    ev.add_argument("--sigmas", help="a JSON file: keypoint sigmas by category id")
    ev.add_argument("--lrp", action="store_true", help="optimal LRP too")
    ev.add_argument("--tables", help="a folder for the per-class, per-image and per-detection tables, as Parquet")
    ev.add_argument("--result-version", type=int, choices=(1, 2), default=1)
    ev.add_argument("--json")
    ag = verbs.add_parser("aggregate", help="robustness over result documents")
    ag.add_argument("results", nargs="+")
    ag.add_argument("--manifest", required=True, help="CSV: key (file name), axes")
    ag.add_argument("--metric", default="AP_0.50:0.95_all_100")
    ag.add_argument("--baseline", required=True, help="axis=value")
    ag.add_argument("--json")
    return top


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from pixelyard.operators import slices, summary
    from pixelyard.plans.instance import Evaluator
    from pixelyard.plans.params import Bbox, Boundary, Keypoints, Params, Segm
    from pixelyard.sources import coco, manifest

    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("pixelyard").getOrCreate()
    try:
        if a.verb == "eval":
            kernel = {"bbox": Bbox(), "segm": Segm(), "boundary": Boundary(a.dilation_ratio), "keypoints": Keypoints(read_sigmas(a.sigmas) if a.sigmas else {})}[a.iou_type]
            masks = a.iou_type in ("segm", "boundary")
            data = coco.check(coco.read_ground_truth(spark, a.gt, masks))
            dt = coco.read_detections(spark, a.dt, images=data.images, masks=masks, mode=a.mode)
            params = Params(mode=a.mode, use_cats=not a.no_cats)
            if a.max_dets:
                params = params.but(max_dets=tuple(int(x) for x in a.max_dets.split(",")))
            document: dict = {"version": a.result_version}
            evaluator = Evaluator(kernel, params.but(iou_thresholds=tuple(float(x) for x in a.iou_thresholds.split(","))) if a.iou_thresholds else params)
            result = evaluator.evaluate_tables(data, dt) if a.iou_thresholds else evaluator.evaluate(data, dt)
            if not a.iou_thresholds:
                rows = result.summary().orderBy("ord").collect()
                print("\n".join(result.text()))
                lines = [(summary.canonical_name(r["metric"], r["iou"], r["area"], r["max_dets"]) + (f"_{r['frequency']}" if r["frequency"] else ""), r) for r in rows]
                value = lambda r: -1.0 if r["value"] is None else r["value"]
                if a.result_version == 1:
                    document["stats"] = {name: value(r) for name, r in lines}
                else:
                    document["lines"] = [{"name": name, "value": value(r), **{k: r[k] for k in ("metric", "iou", "area", "max_dets", "frequency")}} for name, r in lines]
            if a.lrp:
                _, report = evaluator.optimal_lrp(data, dt)
                print("\n".join(summary.lrp_text(report)))
                document["lrp"] = report.first().asDict()
            if a.tables:
                for name, table in (("per_class", result.per_class()), ("per_image", result.per_image()), ("per_detection", result.per_detection())):
                    table.write.mode("overwrite").parquet(f"{a.tables}/{name}")
            if a.manifest:
                table = manifest.read_csv(spark, a.manifest) if a.manifest.endswith(".csv") else manifest.read_json(spark, a.manifest)
                by = result.sliced(table, tuple(tuple(c.split(",")) for c in a.cross)).orderBy("axis", "value", "ord").collect()
                document["slices"] = [r.asDict() for r in by]
        else:
            axis, _, value = a.baseline.partition("=")
            found = manifest.read_results(spark, a.results).where(F.col("metric") == summary.canonical(a.metric)).withColumn("key", F.element_at(F.split("source", "/"), -1))
            labels = spark.read.option("header", True).csv(a.manifest)
            rows = labels.join(found, "key").select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("value")) for c in labels.columns if c != "key"])).alias("x"), F.col("value").alias("score")).select("x.axis", "x.value", "score").where("value is not null")
            per = rows.groupBy("axis", "value").agg(F.avg("score").alias("score"))
            document = {"version": 1, "metric": a.metric, "axes": {r["axis"]: {"mpc": r["mpc"], "rpc": r["rpc"]} for r in slices.robustness(per, "score", (axis, value)).collect()}}
            print(json.dumps(document["axes"], sort_keys=True))
        if a.json:
            write_json(a.json, document)
    except (EvalError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
