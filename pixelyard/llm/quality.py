"""Quality by compression: zstandard dictionaries of good and of bad text, and what each saves.

A text is cut into short blocks, so that what a block saves it saves by the dictionary and not by its
own text; each is compressed with both dictionaries. The sizes' normalised difference says which text a
block resembles. The document's is that which two fifths of its blocks stay under (a few odd blocks
don't decide, a bad stretch does), and a rising curve through the labels' shares makes it a calibrated score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm import textvec
from pixelyard.llm.common import held_out, learned, map_batches

#: Labelled rows that are learned from, at most.
SAMPLE_ROWS = 8_000
#: Bytes of a dictionary, and of a block.
DICTIONARY, BLOCK = 256 << 10, 128
#: Bytes of a piece of text in a dictionary.
PIECE = 128
LEVEL = 12
#: The share of a text's blocks whose differences lie under the text's own.
SHARE = 0.4
#: The part of a score that rises evenly with the difference.
RISE = 0.02
#: Documents with a score from here on are of good quality.
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: tuple[np.ndarray, np.ndarray]
    """differences, and the scores at them"""
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": []}

    def scores(self, column: pa.Array) -> np.ndarray:
        if not self._made:
            self._made += [_compressor(self.good), _compressor(self.bad)]
        return np.interp(measure(column, *self._made), *self.curve)


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    if not raw:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)


def measure(column: pa.Array, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """Per text the normalised size difference of its block at ``SHARE``: positive if the good text's
    dictionary saves more; 0 for an empty text."""
    data, offsets = textvec.flat(column)
    out = np.zeros(len(column))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            raw = data[a:b].tobytes()
            blocks = [raw[x : x + BLOCK] for x in range(0, b - a, BLOCK)]
            g, k = (np.array([len(c.compress(x)) for x in blocks]) for c in (good, bad))
            d, at = (k - g) / np.maximum(g, k), int(SHARE * (len(blocks) - 1))
            out[i] = np.partition(d, at)[at]
    return out


def _dictionary(texts: list[bytes], seed: int = 3) -> bytes:
    """All texts if they fit; else a piece from a seeded place of each equal stretch of the texts laid end to end.

    Every byte of every text, wherever it stands, has the same chance to be learned.
    """
    flat = b"\n".join(texts)
    if len(flat) <= DICTIONARY:
        return flat
    n = DICTIONARY // PIECE
    ends = [len(flat) * i // n for i in range(n + 1)]
    places = np.random.default_rng(seed).integers(ends[:-1], np.maximum(np.array(ends[1:]) - PIECE, ends[:-1]), endpoint=True)
    return b"".join(flat[x : x + PIECE] for x in places.tolist())


def learn(pairs: list[tuple[str, int]], seed: int = 7) -> Model:
    """Dictionaries from half of the pairs, the curve from the other half."""
    order = np.random.default_rng(seed).permutation(len(pairs)).tolist()
    for_dict, for_curve = [pairs[i] for i in order[::2]], [pairs[i] for i in order[1::2]]
    good, bad = (_dictionary([t.encode() for t, y in for_dict if y == k and t]) for k in (1, 0))
    y = np.array([k for _, k in for_curve], dtype=float)
    x = measure(pa.array([t for t, _ in for_curve], pa.large_string()), _compressor(good), _compressor(bad))
    return Model(good, bad, calibrate(x, y))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising curve: the shares of good rows by ``x``, neighbours pooled until they rise.

    A pool's rows have one share, the curve is linear from pool to pool; ``RISE`` of it is a straight line,
    so that no two differences within those learned from have one score. Without both labels it is flat, at their share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return np.array([0.0]), np.array([share])
    pools: list[tuple[float, float, float, float]] = []  # least and largest x, sum of y, rows
    order = np.argsort(x, kind="stable")
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append((a, a, b, 1.0))
        while len(pools) > 1 and (pools[-2][1] == a or pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]):
            (lo, _, good, n), (_, hi, more, k) = pools[-2:]
            pools[-2:] = [(lo, hi, good + more, n + k)]
    lo, hi, good, n = np.array(pools).T
    level = np.repeat(good / n, 2)
    at = np.stack([lo, hi], axis=1).ravel()
    at = at + np.arange(len(at)) * 1e-12
    return at, (1 - RISE) * level + RISE * (at - at[0]) / (at[-1] - at[0])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` labelled texts that aren't held out."""
    return learned(docs, labels, "quality", sample_rows, learn)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the column ``score``: nearer to 1, the label 1 is likelier.

    A null or empty text is measured as nothing saved by either dictionary, so all of them have one
    score. All columns and rows stay, also repeated ones and those without a doc_id; an empty table stays
    empty; a column of that name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    place, schema = docs.columns.index("text"), docs.schema

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(batch.column(place)))], names=[*batch.schema.names, "score"])

    return map_batches(docs, add, type(schema)(list(schema.fields)).add("score", "double"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose scores reach ``THRESHOLD``; all columns stay, whatever their names.

    Rows with equal texts, null and empty ones included, stay or go together; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(sent.value.scores(batch.column(place)) >= THRESHOLD))

    return map_batches(docs, chosen, docs.schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    Every row counts, also repeated ones, null and empty texts and those without a doc_id (held out: the
    checksum of an empty text is 0). Without labels all rows have an even score; an empty table gives no rows.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
