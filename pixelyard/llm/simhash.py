"""SimHash near-duplicates: fingerprints, pigeonring filtering, components.

The 64 bits are seven segments in a ring. If two fingerprints differ in at most two bits, some
segment starts a chain whose first k segments together differ in at most 2k/7 bits, for every k:
the chain's first three segments are equal, the first four to six differ in at most one bit. So
candidates meet on three equal consecutive segments (27 or 28 bits), the chain's budgets prune
them, and only then all bits are compared.

Where many meet, the chain's own budget parts them further: the next three segments differ in at most
one bit, so of any two halves of them one is equal. A crowded meeting becomes two, each with one half
more that is equal, and so on with the other half, until at most one bit of the six segments is open:
then, with the last segment, at most 2,048 different fingerprints can meet. No pair is lost, and no
meeting is left to another method.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelyard.llm import textvec
from pixelyard.llm.common import Scratch, map_batches, staged
from pixelyard.llm.components import components

BITS, DIFFER = 64, 2
SEGMENTS = 7
#: A meeting of more different fingerprints is parted first, while its chain has open bits.
PAIRED = 32
SHINGLE, SEED = 3, 42
#: Shingles whose bits are counted at once: 64 bytes each.
BLOCK = 1 << 16

#: Row numbers (8 bytes each) that are sent to all tasks at most; more are joined by a shuffle.
FEW_DROPPED = 1_000_000
_ROW = "_pixelyard_row"
WIDTHS = [BITS // SEGMENTS + (i < BITS % SEGMENTS) for i in range(SEGMENTS)]
STARTS = [sum(WIDTHS[:i]) for i in range(SEGMENTS)]
#: Segments of a chain that must be equal: those whose budget is under one bit.
EQUAL = max(k for k in range(1, SEGMENTS) if k * DIFFER // SEGMENTS == 0)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain(first: int, n: int) -> int:
    """The bits of ``n`` consecutive segments from ``first`` on, around the ring."""
    return sum(((1 << WIDTHS[i % SEGMENTS]) - 1) << STARTS[i % SEGMENTS] for i in range(first, first + n))


def _meetings() -> list[tuple[int, int, list[int]]]:
    """Every kind of meeting: its chain's first segment, the bits that are equal, the kinds it is parted into.

    The first ``SEGMENTS`` kinds are those that all fingerprints enter.
    """
    kinds: list[tuple[int, int, list[int]]] = [(i, _chain(i, EQUAL), []) for i in range(SEGMENTS)]
    todo = [(i, [b for b in range(BITS) if (_chain(i, SEGMENTS - 1) ^ _chain(i, EQUAL)) >> b & 1]) for i in range(SEGMENTS)]
    for kind, free in todo:
        if len(free) > 1:
            for half, rest in ((free[: len(free) // 2], free[len(free) // 2 :]), (free[len(free) // 2 :], free[: len(free) // 2])):
                at, equal, parts = kinds[kind]
                parts.append(len(kinds))
                todo.append((len(kinds), rest))
                kinds.append((at, equal | sum(1 << b for b in half), []))
    return kinds


MEETINGS = _meetings()


def _fingerprints(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for w in textvec.words(column, textvec.VISIBLE):
        n = len(w.starts)
        if not n:
            continue
        lengths = w.ends - w.starts
        at = np.cumsum(lengths + 1) - (lengths + 1)
        spaced = np.full(int(lengths.sum()) + n, 32, dtype=np.uint8)
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        spaced[np.repeat(at, lengths) + inside] = w.data[np.repeat(w.starts, lengths) + inside]
        raw, stops = spaced.tobytes(), at + lengths
        # a text's shingles start at each of its words that has two after it, or at its first if it has fewer
        tail = w.begin[w.doc + 1]
        starts = np.flatnonzero((np.arange(n) + SHINGLE <= tail) | (np.arange(n) == w.begin[w.doc]))
        ends = np.minimum(starts + SHINGLE, tail[starts]) - 1
        doc = w.doc[starts]
        set_bits = np.zeros((w.last - w.first, 64), dtype=np.int64)
        for i in range(0, len(starts), BLOCK):
            a, b, d = at[starts[i : i + BLOCK]].tolist(), stops[ends[i : i + BLOCK]].tolist(), doc[i : i + BLOCK]
            h = np.array([digest(raw[x:y], SEED) for x, y in zip(a, b, strict=True)], dtype="<u8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            set_bits[d[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        total = np.bincount(doc, minlength=w.last - w.first)
        most = (2 * set_bits > total[:, None]).astype(np.uint64)
        out[w.first : w.last] = (most << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``fp`` of each row, beside its columns ``keep`` (else ``doc_id``): the 64 bits as a signed long.

    A null text, and one without words, has 0; an empty table gives no rows; repeated rows give repeated rows.
    """
    if keep is None:
        docs, keep = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())])

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(_fingerprints(batch["text"]).view(np.int64))], names=[*keep, "fp"])

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), prints, schema)


def links(prints: DataFrame, scratch: Scratch | None = None, paired: int = PAIRED) -> DataFrame:
    """``a, b``: the pairs of the different ``fp`` that differ in at most two bits."""
    scratch = scratch or Scratch(prints.sparkSession)
    of = lambda pick: F.array(*[F.lit(pick(k)) for k in MEETINGS])
    at, equal = of(lambda k: k[0]), of(lambda k: _signed(k[1]))
    parted = F.array(*[F.array(*[F.lit(x) for x in k[2]]).cast("array<int>") for k in MEETINGS])
    keys = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("kind"))
    found = None
    while True:
        keys = keys.select("fp", "kind", F.col("fp").bitwiseAND(equal[F.col("kind")]).alias("part"))
        sizes = keys.groupBy("kind", "part").agg(F.count("*").alias("n")).where("n > 1")
        met = scratch.stage(keys.join(sizes, ["kind", "part"]), "met")
        small = (F.col("n") <= paired) | (F.size(parted[F.col("kind")]) == 0)
        a, b = (met.where(small).select("kind", "part", F.col("fp").alias(x)) for x in "ab")
        differ, budgets = F.col("a").bitwiseXOR(F.col("b")), F.lit(True)
        for k in range(EQUAL + 1, SEGMENTS):
            masks = F.array(*[F.lit(_signed(_chain(i, k))) for i in range(SEGMENTS)])
            budgets &= F.bit_count(differ.bitwiseAND(masks[at[F.col("kind")]])) <= k * DIFFER // SEGMENTS
        pairs = a.join(b, ["kind", "part"]).where((F.col("a") < F.col("b")) & budgets & (F.bit_count(differ) <= DIFFER)).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        crowded = met.where(~small)
        if crowded.isEmpty():
            return found
        keys = crowded.select("fp", F.explode(parted[F.col("kind")]).alias("kind"))


def _rooted(different: DataFrame, scratch: Scratch) -> DataFrame:
    """``different(fp, least)`` with ``first``, the least of its component's."""
    roots = components(links(different, scratch), scratch)
    rooted = different.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")), "root").select("fp", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links of at most two differing bits. A null
    text counts as empty; texts without words have the fingerprint 0, linked like any other. Repeated
    rows give repeated rows. A null doc_id is never a component's id unless all of its rows have none.
    An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    prints = staged(fingerprints(docs), "prints")
    different = scratch.stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "different")
    named = staged(_rooted(different, scratch), "named")
    scratch.drop()
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; all columns stay.

    Rows are told apart by their place, not by doc_id: different texts of one doc_id both stay, and of
    copies one stays, also if they share a doc_id or have none (such a row stays only if no copy has
    one). Of equal doc_ids the first row stays. A null text counts as empty; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    # a row's place must be the same for its fingerprint and when it is kept, whatever docs comes from
    rows = staged(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    prints = scratch.stage(fingerprints(rows.select(_ROW, F.col("doc_id").cast("long").alias("doc_id"), "text"), [_ROW, "doc_id"]), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _ROW)
    different = scratch.stage(prints.groupBy("fp").agg(F.min(order).alias("least")), "different")
    named = _rooted(different, scratch).select("fp", F.col(f"first.{_ROW}").alias("stays"))
    dropped = staged(prints.join(named, "fp").where(F.col(_ROW) != F.col("stays")).select(_ROW), "dropped")
    scratch.drop()
    few = dropped.count() <= FEW_DROPPED
    return rows.join(F.broadcast(dropped) if few else dropped, _ROW, "left_anti").select(*[rows[f"`{c}`"] for c in docs.columns])
