"""Benchmark decontamination: hashed benchmark windows, broadcast in blocks of a bounded size.

Every window of ``WINDOW`` consecutive words of a benchmark item (a shorter item is one window) goes
into a table of hashes. Document windows are hashed the same way; a hash that is in the table is
verified by its words. A table of more than ``BLOCK_ROWS`` (window, item) pairs or ``BLOCK_BYTES`` is
cut into blocks, each scanned on its own over all documents, and the findings are merged by document.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelyard.llm import textvec
from pixelyard.llm.common import map_batches, staged

WINDOW = 10
#: (window, item) pairs in one broadcast; at some 150 bytes each, 150 MB at most.
BLOCK_ROWS = 1_000_000
#: Bytes of their words and names, of which none is much longer than others, in one broadcast.
BLOCK_BYTES = 128 << 20
_Q = np.uint64(0x9FB21C651E98DF25)
_FILTER_BITS = 22
_ROW, _SPANS = "_pixelyard_row", "_pixelyard_spans"

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]


def _window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` consecutive word hashes."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for k in range(1, length):
        out *= _Q
        out += h[k : k + n]
    return textvec.mix(out)


def windows(items: DataFrame) -> DataFrame:
    """``item, length, window`` of each item of ``items(item_id, text)``, each once; null item ids are left out."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: set[tuple[str, int, bytes]] = set()
        ids = batch["item"].to_pylist()
        for w in textvec.words(batch["text"]):
            for d in range(w.last - w.first):
                ws = [w.text(i) for i in range(w.begin[d], w.begin[d + 1])]
                for i in range(max(1, len(ws) - WINDOW + 1) if ws else 0):
                    part = ws[i : i + WINDOW]
                    rows.add((ids[w.first + d], len(part), b" ".join(part)))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.string()), pa.array(list(columns[1]), pa.int32()), pa.array(list(columns[2]), pa.binary())], names=["item", "length", "window"])

    named = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    return map_batches(named, cut, "item string, length int, window binary").distinct()


class Index:
    """The windows of one block: by length, sorted hashes, their words and their items."""

    def __init__(self, rows: list[tuple[str, int, bytes]]):
        by: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
        for item, length, window in rows:
            by[length][window].append(item)
        self.lengths = {}
        for length, found in by.items():
            texts = sorted(found)
            column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_string())
            h = np.concatenate([_window_hashes_of_rows(w, length) for w in textvec.words(column)]) if texts else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
            maybe[h & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.lengths[length] = (h[order], [texts[i] for i in order], [sorted(found[texts[i]]) for i in order], maybe)

    def find(self, w: textvec.Words) -> list[tuple[int, int, list[str]]]:
        """(first word, length, items) of each verified window of a piece's texts, by place."""
        h, out, tail = w.hashes(), [], w.begin[w.doc + 1]
        for length, (known, texts, items, maybe) in self.lengths.items():
            seen = _window_hashes(h, length)
            at = np.flatnonzero(maybe[seen & np.uint64((1 << _FILTER_BITS) - 1)])
            at = at[at + length <= tail[at]]
            lo, hi = np.searchsorted(known, seen[at], "left"), np.searchsorted(known, seen[at], "right")
            for i, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                words = b" ".join([w.text(j) for j in range(i, i + length)])
                out += [(i, length, items[k]) for k in range(a, b) if texts[k] == words]
        return sorted(out, key=lambda x: x[0])


def _window_hashes_of_rows(w: textvec.Words, length: int) -> np.ndarray:
    return _window_hashes(w.hashes(), length)[w.begin[:-1]]


def _scan(docs: DataFrame, rows: DataFrame, extra: list[str]) -> DataFrame:
    """``extra.., n_words, spans, items`` of each document, for the windows of one block."""
    index = _broadcast(docs, rows)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        n_words, spans, items = np.zeros(n, dtype=np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
        for w in textvec.words(batch["text"]):
            n_words[w.first : w.last] = w.counts
            for d, (own, named) in _spans(index.value.find(w), w).items():
                spans[w.first + d] = [{"start": a, "end": b} for a, b in own]
                items[w.first + d] = sorted(named)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([*(batch[x] for x in extra), pa.array(n_words), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=[*extra, "n_words", "spans", "items"])

    schema = T.StructType([*(docs.schema[x] for x in extra), *_FOUND])
    return map_batches(docs.select(*extra, "text"), scan, schema)


def _blocks(found: DataFrame, block_rows: int) -> list[DataFrame]:
    """The windows, cut into parts that can be sent to all tasks."""
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()
    blocks = max(1, -(-n // block_rows), -(-size // BLOCK_BYTES))
    return [found if blocks == 1 else found.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == i) for i in range(blocks)]


def contamination(docs: DataFrame, benchmark: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, n_words, spans, items`` of each row of ``docs(doc_id, text)``.

    ``spans`` are the hit words, from ``start`` up to ``end``, merged where they touch; ``items`` the
    sorted ids, as strings, of the benchmark items that have a window in the text. A null or empty
    text has no words and no hits; an item without words, or without an id, has no windows; items of
    one id are one item; repeated documents give repeated rows; an empty table gives no rows; other
    columns are ignored.
    """
    blocks = _blocks(staged(windows(benchmark), "windows"), block_rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(blocks) == 1:
        return _scan(docs, blocks[0], ["doc_id"])
    return _merged(staged(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered"), blocks).drop(_ROW)


def _merged(numbered: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """What ``_scan`` finds for all blocks together, by row number."""
    parts = None
    for block in blocks:
        part = _scan(numbered, block, ["doc_id", _ROW])
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy(_ROW).agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        for row in batch["spans"].to_pylist():
            own: list[dict] = []
            for s in row:
                if own and s["start"] <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], s["end"])
                else:
                    own.append(s)
            spans.append(own)
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch[_ROW], batch["n_words"], pa.array(spans, batch["spans"].type), batch["items"]], names=["doc_id", _ROW, "n_words", "spans", "items"])

    schema = T.StructType([numbered.schema["doc_id"], T.StructField(_ROW, T.LongType()), *_FOUND])
    return map_batches(merged.select("doc_id", _ROW, "n_words", "spans", "items"), joined, schema)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``contamination``: hit words and items counted, the items' list hashed.

    One row per row of ``docs``, also of repeated ones; null and empty texts have no words; an empty
    table gives no rows.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, cut: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` without the contaminated documents, or, with ``cut``, without the hit words' text.

    All columns and all other rows stay, also repeated ones and those with null or empty texts. With
    ``cut``, the text goes from the first to the last word of each run of hit words, as ``contamination``
    finds them in the whole text, however many blocks there are. An empty table stays empty; without
    benchmark windows nothing goes.
    """
    blocks = _blocks(staged(windows(benchmark), "windows"), block_rows)
    if not cut:  # a document that any block finds goes: one after the other
        for block in blocks:
            docs = _clean_of(docs, block, False)
        return docs
    if len(blocks) == 1:
        return _clean_of(docs, blocks[0], True)
    numbered = staged(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    found = _merged(numbered, blocks).where(F.size("spans") > 0).select(_ROW, F.col("spans").alias(_SPANS))
    joined = numbered.join(found, _ROW, "left").select(*[numbered[f"`{c}`"] for c in docs.columns], _SPANS)
    place = docs.columns.index("text")

    def shorten(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, shorter = batch.column(place), {}
        marked = np.flatnonzero(batch.column(batch.num_columns - 1).is_valid().to_numpy(zero_copy_only=False))
        for w in textvec.words(column):
            for i in marked[(marked >= w.first) & (marked < w.last)].tolist():
                spans = batch.column(batch.num_columns - 1)[i].as_py()
                shorter[i] = _without(column[i].as_py(), w, i - w.first, [(s["start"], s["end"]) for s in spans])
        texts = pa.array([shorter.get(i, x) for i, x in enumerate(column.to_pylist())], column.type)
        return pa.RecordBatch.from_arrays([*batch.columns[:place], texts, *batch.columns[place + 1 : -1]], names=batch.schema.names[:-1])

    return map_batches(joined, shorten, docs.schema)


def _without(text: str, w: textvec.Words, d: int, spans: list[tuple[int, int]]) -> str:
    """The ``d``-th text of a piece without the words of ``spans`` and what lies between them."""
    raw, at, out, first = text.encode(), 0, [], int(w.begin[d])
    for start, end in spans:
        out.append(raw[at : int(w.starts[first + start] - w.at[d])])
        at = int(w.ends[first + end - 1] - w.at[d])
    return b"".join([*out, raw[at:]]).decode()


def _clean_of(docs: DataFrame, rows: DataFrame, cut: bool) -> DataFrame:
    index = _broadcast(docs, rows)
    place = docs.columns.index("text")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(place)
        hit = np.zeros(batch.num_rows, dtype=bool)
        shorter: dict[int, str] = {}
        for w in textvec.words(column):
            for d, (spans, _) in _spans(index.value.find(w), w).items():
                hit[w.first + d] = True
                if cut:
                    shorter[w.first + d] = _without(column[w.first + d].as_py(), w, d, spans)
        if not cut:
            return batch.filter(pa.array(~hit))
        texts = pa.array([shorter.get(i, x) for i, x in enumerate(column.to_pylist())], column.type)
        return pa.RecordBatch.from_arrays([*batch.columns[:place], texts, *batch.columns[place + 1 :]], names=batch.schema.names)

    return map_batches(docs, keep, docs.schema)


def _spans(found: list[tuple[int, int, list[str]]], w: textvec.Words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """For each text of a piece that has hits: its runs of hit words, merged where they touch, and the items."""
    out: dict[int, tuple[list[tuple[int, int]], set[str]]] = defaultdict(lambda: ([], set()))
    for i, length, items in found:
        d = int(w.doc[i])
        spans, named = out[d]
        start = i - int(w.begin[d])
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], start + length))
        else:
            spans.append((start, start + length))
        named.update(items)
    return out


def _broadcast(docs: DataFrame, rows: DataFrame):
    """The index of one block's windows, which ``BLOCK_ROWS`` and ``BLOCK_BYTES`` bound, for the tasks over ``docs``."""
    table = rows.toArrow()
    return docs.sparkSession.sparkContext.broadcast(Index(list(zip(table["item"].to_pylist(), table["length"].to_pylist(), table["window"].to_pylist(), strict=True))))
