"""Shared plumbing: table access, staged tables, Arrow batch mapping."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelyard.workers import ship

#: Python workers get batches of at most this many bytes, so that a run of very long texts
#: cannot fill a worker.
BATCH_BYTES = 8 << 20
#: numpy passes work on pieces of about this many text bytes (one longer text is its own piece).
PIECE_BYTES = 1 << 20
#: Bytes of the texts that a model is learned from, at most.
SAMPLE_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session leaves it unset, a local session (tests) gets a temporary folder; on a cluster
    that is an error, because its machines share none.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pixelyard-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables that are removed when what was made of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = staged_path(self.spark, name)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, but: int = 0) -> None:
        """Remove all but the last ``but`` tables."""
        gone = self.paths[: len(self.paths) - but]
        for path in gone:
            drop_staged(self.spark, path)
        self.paths = self.paths[len(gone) :]


def drop_staged(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def map_batches(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: T.StructType | str,
    setup: Callable[[], None] | None = None,
) -> DataFrame:
    """``mapInArrow`` of a function from one batch to one batch."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup is not None:
            setup()
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def held_out() -> F.Column:
    """True for the fifth of the documents whose labels are never learned from."""
    return held_out_of(F.col("doc_id"))


def held_out_of(doc_id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def learned(docs: DataFrame, labels: DataFrame, label: str, rows: int, learn: Callable[[list[tuple[str, int]]], object], most_bytes: int = SAMPLE_BYTES) -> object:
    """What ``learn`` makes of a bounded sample of (text, label) pairs of ``docs``, never of the held-out fifth.

    The sample is the ``rows`` labels whose hashed doc_id is smallest, spread over the whole table; a
    text that would take its bytes over ``most_bytes`` is left out, never cut. The chosen labels are
    ``rows`` small rows, so they are broadcast; their texts go in a fixed order through one task, which
    holds no more than the bound and learns, so that the driver sees the model only. A doc_id that is
    repeated counts once, with its least text; null labels and null doc_ids are left out; a null text
    counts as empty.
    """
    place = F.xxhash64("doc_id")
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out_of(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(place, "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[str, int]] = []
        size = 0
        for batch in batches:
            for text, k in zip(batch["text"], batch["label"].to_pylist(), strict=True):
                n = len(text.as_buffer())
                if size + n <= most_bytes:
                    size += n
                    pairs.append((text.as_py(), k))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(pairs))], pa.binary())], names=["model"])

    ordered = found.repartition(1).sortWithinPartitions(place, "doc_id").select("text", "label")
    made = ordered.mapInArrow(run, "model binary").first()
    return learn([]) if made is None else pickle.loads(made["model"])
