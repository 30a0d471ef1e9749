"""Label maps from PNG files: inflate, undo the row filters, pack the channels. No imaging library."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pixelyard.errors import InvalidAnnotation
from pixelyard.workers import ship

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """(h, w, channels) of an 8-bit, non-interlaced PNG; a palette's indices stay as they are."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise InvalidAnnotation("not a PNG")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise InvalidAnnotation("a PNG chunk's checksum is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in _CHANNELS:
        raise InvalidAnnotation("only 8-bit PNGs without interlace are read")
    w, h, c = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), dtype=np.uint8)
    above = np.zeros(w * c, dtype=np.uint8)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:]
        if kind == 0:
            row = line.copy()
        elif kind == 2:
            row = line + above
        elif kind == 1:
            row = np.cumsum(line.reshape(-1, c), axis=0, dtype=np.uint8).ravel()
        elif kind in (3, 4):
            row = _sequential(line, above, c, kind)
        else:
            raise InvalidAnnotation("unknown PNG row filter")
        out[y] = above = row
    return out.reshape(h, w, c)


def _sequential(line: np.ndarray, above: np.ndarray, c: int, kind: int) -> np.ndarray:
    row, x, b = [0] * len(line), line.tolist(), above.tolist()
    for i, value in enumerate(x):
        left, up = row[i - c] if i >= c else 0, b[i]
        if kind == 3:
            row[i] = (value + (left + up) // 2) & 255
            continue
        corner = b[i - c] if i >= c else 0
        guess = left + up - corner
        near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))
        row[i] = (value + near[2]) & 255
    return np.array(row, dtype=np.uint8)


def panoptic_ids(data: bytes) -> np.ndarray:
    """Segment ids ``R + 256 G + 65536 B``."""
    rgb = decode(data)
    if rgb.shape[2] < 3:
        raise InvalidAnnotation("a panoptic PNG has three channels")
    c = rgb.astype(np.int64)
    return c[:, :, 0] + 256 * c[:, :, 1] + 65536 * c[:, :, 2]


def label_map(data: bytes) -> np.ndarray:
    return decode(data)[:, :, 0].astype(np.int64)


def runs(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, label) along the rows."""
    flat = labels.ravel()
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if flat.size else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, flat.size)), flat[starts]


def read_runs(spark: SparkSession, path: str, panoptic: bool = True) -> DataFrame:
    """``file_name, start, len, segment_id`` of every PNG under ``path``."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content")

    def decode_batch(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start, n, label = runs(panoptic_ids(data) if panoptic else label_map(data))
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(start)), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(label, pa.int64())], names=["file_name", "start", "len", "segment_id"])

    return files.mapInArrow(decode_batch, "file_name string, start long, len long, segment_id long")
