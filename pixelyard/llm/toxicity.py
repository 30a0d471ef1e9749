"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

Features of a text, each counted once: its words, their first four bytes (inflected words share
them), pairs of neighbours, and pairs with one or two words between them. Every coordinate has its own rate; the
L1 term leaves most weights at zero, so the model that is broadcast is a short list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm import textvec
from pixelyard.llm.common import held_out, learned, map_batches

#: Weights are addressed by this many bits; the model has at most 2 ** BITS entries of 12 bytes.
BITS = 20
#: Labelled rows that are learned from, at most.
SAMPLE_ROWS = 10_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.1
HEAD = 4
_KINDS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def features(w: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature occurrence of a piece's texts; bucket 0 is left for the bias."""
    h, doc = w.hashes(), w.doc
    docs, keys = [doc, doc], [h * _KINDS[0], w.hashes(HEAD) * _KINDS[1]]
    for gap in (1, 2, 3):
        same = doc[:-gap] == doc[gap:]
        docs.append(doc[:-gap][same])
        keys.append(h[:-gap][same] * _KINDS[1 + gap] + h[gap:][same])
    bucket = (textvec.mix(np.concatenate(keys)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(docs), np.maximum(bucket, 1)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[self.buckets] = self.weights
        return dense

    def scores(self, column: pa.Array, table: np.ndarray) -> np.ndarray:
        total = np.full(len(column), float(table[0]))
        for w in textvec.words(column):
            doc, bucket = features(w)
            weighs = table[bucket] != 0
            once = np.unique((doc[weighs] << BITS) | bucket[weighs])
            total[w.first : w.last] += np.bincount(once >> BITS, weights=table[once & ((1 << BITS) - 1)], minlength=w.last - w.first)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def learn(pairs: list[tuple[str, int]], seed: int = 7) -> Model:
    """FTRL-proximal over (text, label) pairs, in a shuffled order fixed by ``seed``; no pairs give an even score."""
    column = pa.array([t for t, _ in pairs], pa.large_string())
    sets: list[np.ndarray] = []
    for w in textvec.words(column):
        doc, bucket = features(w)
        once = np.unique((doc << BITS) | bucket)
        ends = np.searchsorted(once >> BITS, np.arange(w.last - w.first + 1))
        own = (once & ((1 << BITS) - 1)).astype(np.int32)
        sets += [np.append(own[a:b], np.int32(0)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(sets)).tolist():
            at = sets[i]
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - pairs[i][1]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    w = weights(np.arange(1 << BITS))
    kept = np.flatnonzero(w)
    return Model(kept, w[kept].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` labelled texts that aren't held out."""
    return learned(docs, labels, "toxic", sample_rows, learn)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the column ``score``: nearer to 1, the label 1 is likelier.

    A null or empty text has the score of the bias alone. All columns and rows stay, also repeated ones
    and those without a doc_id; an empty table stays empty; a column of that name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    place, schema = docs.columns.index("text"), docs.schema
    made: list[np.ndarray] = []

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(sent.value.table())
        scores = sent.value.scores(batch.column(place), made[0])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    return map_batches(docs, add, type(schema)(list(schema.fields)).add("score", "double"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose scores stay under a half; all columns stay, whatever their names.

    Rows with equal texts, null and empty ones included, stay or go together; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    made: list[np.ndarray] = []

    def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(sent.value.table())
        return batch.filter(pa.array(sent.value.scores(batch.column(place), made[0]) < 0.5))

    return map_batches(docs, chosen, docs.schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    Every row counts, also repeated ones, null and empty texts and those without a doc_id (held out: the
    checksum of an empty text is 0). Without labels all rows have an even score; an empty table gives no rows.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
