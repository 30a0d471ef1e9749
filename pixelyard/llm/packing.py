"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities.

Only lengths and checksums leave the tokenizing tasks, never texts. The pieces are dealt to random
groups of a bounded expected size; each group is packed alone, by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm.common import map_batches, staged

#: Tokens of a sequence.
SEQUENCE = 2048
#: Pieces of a group, on average: enough for little padding, few enough for one task.
GROUP_PIECES = 16_384
#: Consecutive pieces of one document that stay in one group.
RUN_PIECES = 1_024

_OWN = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PIECES = ", ".join(f"{c} long" for c in [*_OWN, "sequence_id", "offset"])


class Tournament:
    """A winner tree over bins in order of opening; each inner node holds its subtree's most free room."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room; its number and what was free there."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        free = most[node]
        most[node] = free - size
        bin_ = node - self.leaves
        node //= 2
        while node:
            left, right = most[2 * node], most[2 * node + 1]
            best = left if left >= right else right
            if most[node] == best:
                break
            most[node] = best
            node //= 2
        return bin_, free


def first_fit_decreasing(lengths: Iterable[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each piece; pieces of equal length keep their order."""
    lengths = np.asarray(lengths, dtype=np.int64)
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    if len(lengths):
        order = np.argsort(-lengths, kind="stable")
        tree = Tournament(len(lengths), capacity)
        for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
            bins[i], free = tree.place(size)
            offsets[i] = capacity - free
    return bins, offsets


def cut(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE) -> DataFrame:
    """Tokenize whole texts, end each with ``end_id``, cut into pieces of at most ``sequence`` ids.

    ``rid`` tells the rows of ``docs`` apart, also those that share a doc_id or have none.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        from pixelyard.llm.tokens import encoder

        rows: list[tuple] = []
        for rid, doc_id, ids in zip(batch["rid"].to_pylist(), batch["doc_id"].to_pylist(), encoder(tokenizer).encode(batch["text"]), strict=True):
            ids += end
            n = len(ids) // 4
            rows += [(rid, doc_id, at, min(sequence, n - at), zlib.crc32(ids[4 * at : 4 * (at + sequence)]), n) for at in range(0, n, sequence)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["rid", *_OWN])

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(numbered, encode, f"rid long, {', '.join(f'{c} long' for c in _OWN)}")


def pack(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack documents into sequences of at most ``sequence`` tokens.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``; the ids
    of a document lie in its pieces in order, each in exactly one. Every row of ``docs`` counts, also
    repeated ones and those with a null doc_id; a null or empty text is its end id alone; an empty
    table gives no rows. Other columns are ignored. A row's group follows from its place in the table,
    so rows of one doc_id, or of none, are dealt like any others; pieces of equal length are placed in
    the order of (doc_id, start, place), nulls first, and a rerun over the same files gives the same
    sequences.
    """
    pieces = staged(cut(docs, tokenizer, end_id, sequence), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("rid", F.floor(F.col("start") / (sequence * RUN_PIECES)), F.lit("group")), F.lit(groups)))

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("doc_id", "start", "rid")], null_placement="at_start"))
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), sequence)
        return pa.table([*(rows[c] for c in _OWN), pa.array((key[0].as_py() << 32) + bins), pa.array(offsets)], names=[*_OWN, "sequence_id", "offset"])

    return dealt.groupBy("group").applyInArrow(fit, PIECES)
