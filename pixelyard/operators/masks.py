"""Masks as run lengths, and what is computed from them.

Runs go down the columns, one column after the other, and start with background. Everything here works
on numpy arrays of run ends; the column functions at the end apply it to Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelyard.errors import DimensionMismatch, InvalidAnnotation

_COUNTS = T.ArrayType(T.LongType())
MASK = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("counts", _COUNTS)])
#: Polygon vertices are rounded to a fifth of a pixel.
FINE = 5


def from_ends(ends: np.ndarray, size: int) -> np.ndarray:
    """Run lengths of a mask that changes at each of ``ends``; places that stand twice cancel out."""
    places, times = np.unique(np.asarray(ends, dtype=np.int64), return_counts=True)
    places = places[(times % 2 == 1) & (places < size)]
    return np.diff(np.concatenate([[0], places, [size]]))


def spans(counts: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the foreground runs that have a length."""
    ends = np.cumsum(np.asarray(counts, dtype=np.int64))
    starts, stops = ends[0:-1:2] if len(ends) % 2 == 0 else ends[:-1:2], ends[1::2]
    full = stops > starts
    return starts[full], stops[full]


def area(counts: Sequence[int]) -> int:
    return int(np.sum(np.asarray(counts, dtype=np.int64)[1::2]))


def bounds(counts: Sequence[int], h: int) -> tuple[float, float, float, float]:
    """The tight box; a run over a column's end has the full height."""
    starts, stops = spans(counts)
    if not len(starts) or not h:
        return 0.0, 0.0, 0.0, 0.0
    x0, x1 = starts // h, (stops - 1) // h
    over = x1 > x0
    top, bottom = np.where(over, 0, starts % h), np.where(over, h - 1, (stops - 1) % h)
    x, y = int(x0.min()), int(top.min())
    return float(x), float(y), float(int(x1.max()) - x + 1), float(int(bottom.max()) - y + 1)


def overlap(a: Sequence[int], b: Sequence[int]) -> int:
    """Pixels in both masks: at each change of either, how far both are covered so far."""
    (s0, e0), (s1, e1) = spans(a), spans(b)
    if not len(s0) or not len(s1):
        return 0
    lo, hi = np.searchsorted(e1, s0, side="right"), np.searchsorted(s1, e0, side="left")
    covered = np.concatenate([[0], np.cumsum(e1 - s1)])
    upto = lambda x, i: covered[i] + np.maximum(0, np.where(i < len(s1), np.minimum(x, e1[np.minimum(i, len(s1) - 1)]) - s1[np.minimum(i, len(s1) - 1)], 0))
    return int(np.sum(np.where(hi > lo, upto(e0, np.maximum(hi - 1, 0)) - upto(s0, lo), 0)))


def merge(masks: Iterable[Sequence[int]], size: int, intersect: bool = False) -> np.ndarray:
    """The union (or intersection) of masks of one size."""
    masks = [np.asarray(m, dtype=np.int64) for m in masks]
    if any(int(m.sum()) != size for m in masks):
        raise DimensionMismatch("masks of different sizes")
    pairs = [spans(m) for m in masks]
    starts, stops = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    places = np.concatenate([starts, stops])
    step = np.concatenate([np.ones(len(starts), np.int64), -np.ones(len(stops), np.int64)])
    order = np.argsort(places, kind="stable")
    places, depth = places[order], np.cumsum(step[order])
    last = np.append(places[1:] != places[:-1], True) if len(places) else np.zeros(0, bool)
    places, inside = places[last], depth[last] >= (len(masks) if intersect else 1)
    changes = inside != np.append(False, inside[:-1])
    return from_ends(places[changes], size)


def encode(raster: np.ndarray) -> np.ndarray:
    """Run lengths of an (h, w) raster; anything but 0 is foreground."""
    flat = np.asarray(raster, order="F").ravel(order="F") != 0
    return from_ends(np.flatnonzero(flat != np.append(False, flat[:-1])), flat.size)


def decode(counts: Sequence[int], h: int, w: int) -> np.ndarray:
    counts = np.asarray(counts, dtype=np.int64)
    if int(counts.sum()) != h * w:
        raise DimensionMismatch("run lengths don't fill the mask")
    return np.repeat(np.arange(len(counts)) % 2, counts).astype(np.uint8).reshape((h, w), order="F")


def to_text(counts: Sequence[int]) -> str:
    """The compact form: each length (from the third run's successor on less the one before last), five bits a character."""
    out = []
    for i, n in enumerate(int(c) for c in counts):
        value = n - int(counts[i - 2]) if i > 2 else n
        while True:
            low, value = value & 31, value >> 5
            more = value != (-1 if low & 16 else 0)
            out.append(chr(48 + (low | 32 * more)))
            if not more:
                break
    return "".join(out)


def from_text(text: str) -> list[int]:
    counts: list[int] = []
    value = shift = 0
    for ch in text:
        code = ord(ch) - 48
        if not 0 <= code < 64:
            raise InvalidAnnotation("a run-length string has a character out of range")
        value |= (code & 31) << shift
        shift += 5
        if not code & 32:
            if code & 16:
                value -= 1 << shift
            counts.append(value + counts[-2] if len(counts) > 2 else value)
            value = shift = 0
    if shift:
        raise InvalidAnnotation("a run-length string ends early")
    if any(c < 0 for c in counts):
        raise InvalidAnnotation("a run has a negative length")
    return counts


def _trunc(x: np.ndarray) -> np.ndarray:
    return np.trunc(x).astype(np.int64)


def from_polygon(points: Sequence[float], h: int, w: int) -> np.ndarray:
    """Rasterise one polygon ``[x0, y0, x1, y1, ..]``.

    The outline is walked on a grid five times as fine; where it changes columns, the crossing that falls
    on a pixel's column toggles all pixels below it.
    """
    xy = np.asarray(points, dtype=np.float64).reshape(-1, 2)
    px, py = _trunc(FINE * xy[:, 0] + 0.5), _trunc(FINE * xy[:, 1] + 0.5)
    us, vs = [], []
    for x0, y0, x1, y1 in zip(px.tolist(), py.tolist(), np.roll(px, -1).tolist(), np.roll(py, -1).tolist(), strict=True):
        dx, dy = abs(x1 - x0), abs(y1 - y0)
        flat = dx >= dy
        back = x0 > x1 if flat else y0 > y1
        if back:
            x0, y0, x1, y1 = x1, y1, x0, y0
        n = dx if flat else dy
        t = np.arange(n, -1, -1) if back else np.arange(n + 1)
        slope = ((y1 - y0) / dx if dx else 0.0) if flat else (x1 - x0) / dy
        along, across = t + (x0 if flat else y0), _trunc((y0 if flat else x0) + slope * t + 0.5)
        us.append(along if flat else across)
        vs.append(across if flat else along)
    u, v = np.concatenate(us), np.concatenate(vs)
    steps = np.flatnonzero(u[1:] != u[:-1]) + 1
    x = (np.where(u[steps] < u[steps - 1], u[steps], u[steps] - 1) + 0.5) / FINE - 0.5
    on = (np.floor(x) == x) & (x >= 0) & (x <= w - 1)
    y = np.clip((np.minimum(v[steps], v[steps - 1]) + 0.5) / FINE - 0.5, 0, h)
    return from_ends(x[on].astype(np.int64) * h + np.ceil(y[on]).astype(np.int64), h * w)


def from_polygons(polygons: Iterable[Sequence[float]], h: int, w: int) -> np.ndarray:
    return merge([from_polygon(p, h, w) for p in polygons], h * w)


def from_box(x: float, y: float, bw: float, bh: float, h: int, w: int) -> np.ndarray:
    return from_polygon([x, y, x, y + bh, x + bw, y + bh, x + bw, y], h, w)


def radius(ratio: float, h: int, w: int) -> int:
    """Half to even, at least one pixel."""
    return max(1, round(ratio * math.sqrt(h * h + w * w)))


def erode(raster: np.ndarray, d: int) -> np.ndarray:
    """What is left if every pixel within ``d`` rows and columns must be foreground; outside is background."""
    h, w = raster.shape
    padded = np.zeros((h + 2 * d + 1, w + 2 * d + 1), dtype=np.int64)
    padded[d + 1 : d + 1 + h, d + 1 : d + 1 + w] = raster != 0
    sums = padded.cumsum(axis=0).cumsum(axis=1)
    k = 2 * d + 1
    window = sums[k:, k:] - sums[:-k, k:] - sums[k:, :-k] + sums[:-k, :-k]
    return (window == k * k).astype(np.uint8)


def band(counts: Sequence[int], h: int, w: int, ratio: float) -> np.ndarray:
    """The mask's boundary: what erosion takes away. Works on the box around the foreground."""
    x, y, bw, bh = (int(v) for v in bounds(counts, h))
    if not bw:
        return np.array([h * w], dtype=np.int64)
    d = radius(ratio, h, w)
    part = decode(counts, h, w)[y : y + bh, x : x + bw]
    out = np.zeros((h, w), dtype=np.uint8)
    out[y : y + bh, x : x + bw] = part & ~erode(part, d) & 1
    return encode(out)


def iou(a: dict, b: dict, crowd: bool) -> float:
    if (a["h"], a["w"]) != (b["h"], b["w"]):
        raise DimensionMismatch("masks of different sizes")
    inter, small = overlap(a["counts"], b["counts"]), area(b["counts"])
    bottom = small if crowd else area(a["counts"]) + small - inter
    return inter / bottom if bottom else 0.0


def normalise(segmentation, h: int, w: int) -> dict | None:
    """Polygons, run lengths or their text as one mask."""
    if segmentation is None or (isinstance(segmentation, list) and not segmentation):
        return None
    if isinstance(segmentation, list):
        return {"h": h, "w": w, "counts": from_polygons(segmentation, h, w).tolist()}
    mh, mw = segmentation["size"]
    if (mh, mw) != (h, w):
        raise DimensionMismatch(f"a mask of {mh}x{mw} in an image of {h}x{w}")
    counts = segmentation["counts"]
    counts = from_text(counts) if isinstance(counts, str) else [int(c) for c in counts]
    if sum(counts) != h * w:
        raise DimensionMismatch("run lengths don't fill the mask")
    return {"h": h, "w": w, "counts": counts}


@F.pandas_udf(MASK)
def mask_of_json(segmentation: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """The mask of a segmentation's JSON text."""
    import json

    rows = [normalise(json.loads(s), int(h), int(w)) if s else None for s, h, w in zip(segmentation, height, width, strict=True)]
    return pd.DataFrame([r or {"h": None, "w": None, "counts": None} for r in rows], columns=["h", "w", "counts"])


def mask_band(mask: Column, ratio: float) -> Column:
    """The boundary mask of a mask column."""

    @F.pandas_udf(_COUNTS)
    def run(h: pd.Series, w: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else band(c, int(a), int(b), ratio).tolist() for a, b, c in zip(h, w, counts, strict=True)])

    return F.struct(mask["h"].alias("h"), mask["w"].alias("w"), run(mask["h"], mask["w"], mask["counts"]).alias("counts"))


@F.pandas_udf(T.DoubleType())
def _iou_of(h: pd.Series, w: pd.Series, g: pd.Series, h2: pd.Series, w2: pd.Series, d: pd.Series, crowd: pd.Series) -> pd.Series:
    rows = zip(h, w, g, h2, w2, d, crowd, strict=True)
    return pd.Series([0.0 if a[2] is None or a[5] is None else iou({"h": a[0], "w": a[1], "counts": a[2]}, {"h": a[3], "w": a[4], "counts": a[5]}, bool(a[6])) for a in rows])


def mask_iou(g: Column, d: Column, crowd: Column, touch: Column) -> Column:
    """Mask IoU where ``touch`` holds, else 0; only those masks go to Python."""
    some = lambda c: F.when(touch, c)
    return _iou_of(g["h"], g["w"], some(g["counts"]), d["h"], d["w"], some(d["counts"]), crowd)


def rle_area(counts: Column) -> Column:
    """Foreground pixels, in the JVM."""
    return F.aggregate(F.filter(counts, lambda c, i: i % 2 == 1), F.lit(0).cast("long"), lambda t, c: t + c)


def rle_spans(counts: Column) -> Column:
    """Foreground spans ``array<struct<lo,hi>>``, in the JVM."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<lo:long,hi:long>>").alias("out"))
    indexed = F.transform(counts, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    step = lambda s, x: F.struct((s["at"] + x["c"]).alias("at"), F.when((x["i"] % 2 == 1) & (x["c"] > 0), F.array_append(s["out"], F.struct(s["at"].alias("lo"), (s["at"] + x["c"]).alias("hi")))).otherwise(s["out"]).alias("out"))
    return F.aggregate(indexed, state, step, lambda s: s["out"])


def rle_overlap(a: Column, b: Column) -> Column:
    """Pixels in both span arrays, in the JVM."""
    zero = F.lit(0).cast("long")
    return F.aggregate(a, zero, lambda t, x: t + F.aggregate(b, zero, lambda u, y: u + F.greatest(zero, F.least(x["hi"], y["hi"]) - F.greatest(x["lo"], y["lo"]))))


def with_bands(df: DataFrame, ratio: float) -> DataFrame:
    """``df`` with ``band``, computed once per mask."""
    return df.withColumn("band", mask_band(F.col("mask"), ratio))
