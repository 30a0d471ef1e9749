"""Content-addressed store of token ids.

A rolling hash over the last 16 ids cuts each document's id stream into chunks, so equal passages
cut alike wherever they stand. A chunk's name is the digest of its ids. Each distinct chunk is
stored once, in the row of the first document (by doc_id) that has it; every document keeps a
recipe, the names and lengths of its chunks in order, and a Merkle root over them. Rows lie in
ascending doc_id order over the parts; the manifest has each part's counts and the root over its
documents' roots, and a row with the sums and the root over the parts' roots. Reading back fetches
the chunks a document lacks by name, checks every name, root and count, those of the parts and of the
whole store included, and fails on any difference.

On disk: ``recipes/`` (Parquet, a row a document) and ``manifest/`` (Parquet, a row a part, and the
store's as part ``WHOLE``).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelyard.llm.common import BATCH_BYTES, Scratch, drop_staged, map_batches, staged_path

DIGEST = 16
#: Ids of a chunk: at least, on average about, at most.
LEAST, MEAN, MOST = 128, 1024, 8192
_MASK = np.uint64(MEAN - 1)
#: The part number of the manifest's row for the whole store.
WHOLE = -1
_WINDOW_STEPS = (1, 2, 4, 8)
#: Ids whose rolling hashes are computed at once.
BLOCK_IDS = 1 << 16
#: A chunk that over one in so many places of the store asks for is handed to all tasks: at most as many
#: chunks of at most ``MOST`` ids, 32 MB; the others' rows are joined by name.
HOT_SHARE = 1000


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place a hash of the 16 ids that end there (fewer near the start)."""
    r = ids.astype(np.uint64)
    r += np.uint64(1)
    r *= np.uint64(0x9E3779B97F4A7C15)
    r ^= r >> np.uint64(29)
    for step in _WINDOW_STEPS:
        r[step:] += r[:-step] << np.uint64(step)
    r *= np.uint64(0xD6E8FEB86659FD93)
    r >>= np.uint64(40)
    return r


def asked(ids: np.ndarray, block: int = BLOCK_IDS) -> np.ndarray:
    """The places whose ``rolling`` hash asks for a cut, computed a block at a time, which stays in the processor's cache."""
    before = sum(_WINDOW_STEPS)
    found = [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(ids), block):
        start = max(0, at - before)
        places = np.flatnonzero((rolling(ids[start : at + block]) & _MASK) == 0) + start
        found.append(places[places >= at])
    return np.concatenate(found)


def cuts(places: np.ndarray, n: int) -> list[int]:
    """Chunk ends of a stream of ``n`` ids whose hash asks for a cut after each of ``places``."""
    ends, last = [], 0
    for p in (places + 1).tolist():
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST and n - p >= LEAST:
            ends.append(p)
            last = p
    while n - last > MOST:
        last += MOST
        ends.append(last)
    ends.append(n)
    return ends


def merkle(leaves: bytes, width: int = DIGEST) -> bytes:
    """The root over digests laid end to end; an odd one at a level's end moves up as it is."""
    if len(leaves) == width:
        return leaves
    level = [leaves[i : i + width] for i in range(0, len(leaves), width)]
    if not level:
        return hashlib.blake2b(b"", digest_size=width).digest()
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=width).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_STAGE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("root", T.BinaryType()),
        T.StructField("names", T.BinaryType()),
        T.StructField("lengths", T.ArrayType(T.IntegerType())),
        T.StructField("ids", T.BinaryType()),
    ]
)
_RECIPE = T.StructType(
    [
        T.StructField("rid", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("root", T.BinaryType()),
        T.StructField("names", T.BinaryType()),
        T.StructField("lengths", T.ArrayType(T.IntegerType())),
        T.StructField("elsewhere", T.ArrayType(T.IntegerType())),
        T.StructField("shared", T.ArrayType(T.IntegerType())),
        T.StructField("ids", T.BinaryType()),
    ]
)


def _encode(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        from pixelyard.llm.tokens import encoder

        end = np.array([end_id], dtype="<u4").tobytes()
        encoded = [x + end for x in encoder(tokenizer).encode(batch["text"])]
        counts = np.array([len(x) // 4 for x in encoded])
        flat = np.frombuffer(b"".join(encoded), dtype="<u4")
        at = np.append(0, np.cumsum(counts))
        places = asked(flat)
        bounds = np.searchsorted(places, at)
        narrow = flat.astype(kind).tobytes()
        size = np.dtype(kind).itemsize
        names, lengths, ids = [], [], []
        for i, ids4 in enumerate(encoded):
            ends = cuts(places[bounds[i] : bounds[i + 1]] - at[i], int(counts[i]))
            starts = [0, *ends[:-1]]
            names.append(b"".join([hashlib.blake2b(ids4[4 * a : 4 * b], digest_size=DIGEST).digest() for a, b in zip(starts, ends, strict=True)]))
            lengths.append([b - a for a, b in zip(starts, ends, strict=True)])
            ids.append(narrow[size * at[i] : size * at[i + 1]])
        roots = [merkle(x) for x in names]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(roots, pa.binary()), pa.array(names, pa.binary()), pa.array(lengths, pa.list_(pa.int32())), pa.array(ids, pa.binary())], names=_STAGE.names)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, _STAGE)


def _refs(rows: DataFrame) -> DataFrame:
    """(name, doc_id, rid, pos) of every chunk of every document."""
    pos = F.explode(F.sequence(F.lit(0), F.size("lengths") - 1)).alias("pos")
    return rows.select("names", "doc_id", "rid", pos).select(F.substring("names", F.col("pos") * DIGEST + 1, F.lit(DIGEST)).alias("name"), "doc_id", "rid", "pos")


def _by_name(refs: DataFrame, table: DataFrame) -> DataFrame:
    """``refs`` joined to ``table(name, n, ..)``, a row a name, on the name.

    ``n`` counts the refs of a name, so fewer than ``HOT_SHARE`` names can have over that share of all;
    those rows go to every task, and no task has to take all refs of such a name.
    """
    hot = F.col("n") > table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HOT_SHARE
    often = F.broadcast(table.where(hot))
    seldom = refs.join(F.broadcast(table.where(hot).select("name")), "name", "left_anti").join(table.where(~hot), "name")
    return refs.join(often, "name").unionByName(seldom)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every whole text and write the store.

    A null or empty text is its end id alone; repeated rows are documents of their own that share
    their chunks; rows with a null doc_id come first. Other columns are ignored. An empty table
    gives a store without rows.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    kind = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
    temp = staged_path(spark, "encoded")
    _encode(docs, tokenizer, end_id, kind).withColumn("rid", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(temp)
    rows = spark.read.parquet(temp)

    scratch = Scratch(spark)
    refs = _refs(rows)
    first = F.min(F.struct("doc_id", "rid", "pos")).alias("first")
    repeated = refs.groupBy("name").agg(first, F.count("*").alias("n")).where("n > 1").select("name", "n", F.col("first.rid").alias("first_rid"), F.col("first.pos").alias("first_pos"))
    repeated = scratch.stage(repeated, "repeated")
    is_first = (F.col("rid") == F.col("first_rid")) & (F.col("pos") == F.col("first_pos"))
    marks = scratch.stage(
        _by_name(refs, repeated)
        .withColumn("is_first", is_first)
        .groupBy("doc_id", "rid")
        .agg(F.collect_list(F.when(~F.col("is_first"), F.col("pos"))).alias("elsewhere"), F.collect_list(F.when(F.col("is_first"), F.col("pos"))).alias("shared")),
        "marks",
    )
    nothing = F.lit(None)
    both = (
        rows.withColumns({"elsewhere": nothing.cast("array<int>"), "shared": nothing.cast("array<int>"), "kind": F.lit(1)})
        .unionByName(marks.withColumns({"kind": F.lit(0)}), allowMissingColumns=True)
        .repartitionByRange("doc_id", "rid")
        .sortWithinPartitions("doc_id", "rid", "kind")
    )
    size = np.dtype(kind).itemsize

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's marks come just before it; keep the ids of those chunks it is the first to have."""
        start, marks = 0, {}
        for batch in batches:
            is_doc = pa.array(batch["kind"].to_numpy() == 1)
            marks |= {row["rid"]: row for row in batch.select(["rid", "elsewhere", "shared", "kind"]).filter(pc.invert(is_doc)).to_pylist()}
            docs = batch.filter(is_doc)
            if not docs.num_rows:
                continue
            rid, ids = docs["rid"].to_numpy(), docs["ids"]
            elsewhere, shared = [[] for _ in rid], [[] for _ in rid]
            marked = np.flatnonzero(np.isin(rid, list(marks))).tolist() if marks else []
            if marked:
                own, lengths = ids.to_pylist(), docs["lengths"]
                for i in marked:
                    mark = marks.pop(int(rid[i]))
                    elsewhere[i], shared[i] = sorted(mark["elsewhere"]), sorted(mark["shared"])
                    if gone := set(elsewhere[i]):
                        ends = size * np.cumsum(lengths[i].values.to_numpy())
                        begins = [0, *ends[:-1].tolist()]
                        own[i] = b"".join([own[i][a:e] for pos, (a, e) in enumerate(zip(begins, ends.tolist(), strict=True)) if pos not in gone])
                ids = pa.array(own, pa.binary())
            n = docs["n_tokens"].to_numpy()
            ends = start + np.cumsum(n)
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([docs["rid"], docs["doc_id"], pa.array(ends - n), docs["n_tokens"], docs["root"], docs["names"], docs["lengths"], pa.array(elsewhere, lists), pa.array(shared, lists), ids], names=_RECIPE.names)
            start = int(ends[-1])

    settled = both.mapInArrow(settle, _RECIPE).withColumns({"part": F.spark_partition_id(), "width": F.lit(size)})
    settled.write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_staged(spark, temp)
    scratch.drop()

    parts = _sealed(spark.read.parquet(f"{path}/recipes"))
    spark.createDataFrame([*parts, _whole(parts)], _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


_MANIFEST = "part int, n_docs long, n_tokens long, root binary"


def _sealed(recipes: DataFrame) -> list[tuple[int, int, int, bytes]]:
    """(part, n_docs, n_tokens, root) of each part, from its documents' rows: a row a file."""

    def seal(key: tuple, rows: pa.Table) -> pa.Table:  # some 32 bytes a document of one file
        rows = rows.sort_by("local_start")
        root = merkle(b"".join(rows["root"].to_pylist()))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([rows.num_rows], pa.int64()), pa.array([pc.sum(rows["n_tokens"]).as_py()], pa.int64()), pa.array([root], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])

    parts = recipes.select("part", "local_start", "n_tokens", "root").groupBy("part").applyInArrow(seal, _MANIFEST)
    return sorted((r["part"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in parts.collect())


def _whole(parts: list[tuple[int, int, int, bytes]]) -> tuple[int, int, int, bytes]:
    return WHOLE, sum(x[1] for x in parts), sum(x[2] for x in parts), merkle(b"".join(x[3] for x in parts))


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Rebuild every document from the store's files and verify it.

    Returns ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (little-endian unsigned
    32-bit). ``start`` counts the ids of all documents before it. The parts' counts and roots are
    recomputed from the documents' and held against the manifest at once, each document against its own
    count and root as it is rebuilt. Rows are as they were written: repeated ones repeat, those with a null
    doc_id come first, an empty text is its end id; a store of an empty table gives no rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = spark.read.parquet(f"{path}/recipes")
    written = sorted((r["part"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in spark.read.parquet(f"{path}/manifest").collect())  # a row a file
    parts = _sealed(rows)
    if written != [_whole(parts), *parts]:
        wrong = sorted({x[0] for x in {*written} ^ {_whole(parts), *parts}})
        raise ValueError(f"{path}: the documents do not give the manifest's counts and roots of parts {wrong[:20]} ({WHOLE}: the whole store)")
    offsets, total = [], 0
    for part, _, n, _ in parts:
        offsets.append((part, total))
        total += n
    offset = spark.createDataFrame(offsets, "part int, before long")

    def shared(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The chunks that other documents look for here."""
        names, ids = [], []
        for row in batch.to_pylist():
            gone, asked, at = set(row["elsewhere"]), set(row["shared"]), 0
            for pos, n in enumerate(row["lengths"]):
                if pos in gone:
                    continue
                end = at + row["width"] * n
                if pos in asked:
                    names.append(row["names"][DIGEST * pos : DIGEST * (pos + 1)])
                    ids.append(row["ids"][at:end])
                at = end
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, pa.binary())], names=["name", "chunk"])

    def supply(rows: DataFrame) -> DataFrame:
        return map_batches(rows.select("names", "lengths", "elsewhere", "shared", "width", "ids"), shared, "name binary, chunk binary")

    named = lambda pos: F.substring("names", F.col(pos) * DIGEST + 1, F.lit(DIGEST)).alias("name")
    lacking, lending = rows.where(F.size("elsewhere") > 0), rows.where(F.size("shared") > 0)
    wanted = lacking.select("rid", "names", F.explode("elsewhere").alias("pos")).select("rid", "pos", named("pos"))
    asked = wanted.groupBy("name").agg(F.count("*").alias("n"))
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [(bytes(r["name"]),) for r in asked.where(F.col("n") > total / HOT_SHARE).select("name").collect()]  # under HOT_SHARE names
    if hot:
        often = F.broadcast(spark.createDataFrame(hot, "name binary"))
        lenders = lending.select("rid", "names", F.explode("shared").alias("pos")).select("rid", named("pos")).join(often, "name").select("rid").distinct()
        chunks = supply(lending.join(F.broadcast(lenders), "rid", "left_semi")).join(often, "name")
        found = wanted.join(F.broadcast(chunks), "name").unionByName(wanted.join(often, "name", "left_anti").join(supply(lending), "name"))
    else:
        found = wanted.join(supply(lending), "name")
    fetched = found.groupBy("rid").agg(F.collect_list(F.struct("pos", "chunk")).alias("fetched"))
    whole = rows.where(F.size("elsewhere") == 0).withColumn("fetched", F.lit(None).cast("array<struct<pos:int,chunk:binary>>"))
    every = whole.unionByName(lacking.join(fetched, "rid", "left"))
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
        fetched, column = batch["fetched"], batch["lengths"]
        at, flat = column.offsets.to_numpy(), column.values.to_numpy()
        crcs, whole_ids = [], []
        rows = zip(batch["doc_id"].to_pylist(), batch["width"].to_pylist(), batch["names"].to_pylist(), batch["root"].to_pylist(), batch["n_tokens"].to_pylist(), batch["ids"].to_pylist(), strict=True)
        for i, (doc_id, width, names, root, n_tokens, raw) in enumerate(rows):
            lengths = flat[at[i] : at[i + 1]].tolist()
            if fetched[i].is_valid:
                got, place, parts = {x["pos"]: x["chunk"] for x in fetched[i].as_py()}, 0, []
                for pos, n in enumerate(lengths):
                    if pos in got:
                        parts.append(got[pos])
                    else:
                        parts.append(raw[place : place + width * n])
                        place += width * n
                raw = b"".join(parts)
            ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4").tobytes()
            place, found = 0, []
            for n in lengths:
                found.append(hashlib.blake2b(ids[place : place + 4 * n], digest_size=DIGEST).digest())
                place += 4 * n
            found = b"".join(found)
            if place != len(ids) or place != 4 * n_tokens or found != names or merkle(found) != root:
                raise ValueError(f"document {doc_id}: the store's chunks do not give its root")
            crcs.append(zlib.crc32(ids))
            whole_ids.append(ids if with_ids else None)
        start = batch["local_start"].to_numpy() + batch["before"].to_numpy()
        arrays = [batch["doc_id"], pa.array(start), batch["n_tokens"], pa.array(crcs, pa.int64()), pa.array(whole_ids, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays[: 4 + with_ids], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    return map_batches(every.join(F.broadcast(offset), "part"), rebuild, fields)
