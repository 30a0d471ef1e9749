"""Streams of detections: each micro-batch brings whole images, its cells are matched and appended.

A snapshot is the batch query over the appended table and all ground truth, so it equals an evaluation
of everything seen so far. An image that comes again in a later batch is an error.

A batch's images are written last and stand for the whole batch: what a failure left of a batch without
them isn't read, and is overwritten when the batch runs again. Numbers go on from the table's, so an
object made after a restart never takes a number again; a query's batches are named by its checkpoint.
"""

from __future__ import annotations

import hashlib
import queue
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelyard.errors import QueueFull, RepeatedImage
from pixelyard.operators.matching import MATCHES
from pixelyard.plans.instance import Evaluator, Result
from pixelyard.sources.coco import Dataset


class _Batches:
    """Tables under ``path`` with a folder a batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def there(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def images(self) -> DataFrame:
        """``image_id, batch`` of the batches that are complete."""
        schema = "image_id long, batch string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/images") if self.there("images") else self.spark.createDataFrame([], schema)

    def rows(self, name: str, schema: str | None = None) -> DataFrame:
        """A table's rows of the batches that are complete."""
        read = self.spark.read.schema(f"{schema}, batch string") if schema else self.spark.read
        table = read.parquet(f"{self.path}/{name}").withColumn("batch", F.col("batch").cast("string"))
        return table.join(F.broadcast(self.images().select("batch").distinct()), "batch", "left_semi").drop("batch")

    def name(self, batch_id: int | None, source: str) -> str:
        if batch_id is not None:
            return f"{source}-{batch_id}"
        numbers = self.images().where(F.col("batch").rlike("^update-[0-9]+$")).select(F.substring("batch", 8, 20).cast("long").alias("n"))
        last = numbers.agg(F.max("n")).first()[0]
        return f"update-{0 if last is None else last + 1}"

    def add(self, batch: str, images: DataFrame, name: str, rows) -> None:
        again = images.join(self.images().where(F.col("batch") != batch), "image_id", "left_semi").first()
        if again is not None:
            raise RepeatedImage(f"image {again['image_id']} came in an earlier batch")
        rows().write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        images.write.mode("overwrite").parquet(f"{self.path}/images/batch={batch}")


class StreamingEvaluator:
    """Appends ``matches`` under ``path``, a folder a batch: a batch that is run again replaces its own."""

    def __init__(self, evaluator: Evaluator, data: Dataset, path: str):
        self.evaluator, self.data = evaluator, data
        self.spark: SparkSession = data.gt.sparkSession
        self.batches = _Batches(self.spark, path)

    def seen(self) -> DataFrame:
        return self.batches.images()

    def update(self, batch: DataFrame, batch_id: int | None = None, source: str = "batch") -> None:
        """Match one batch of detections; also the callback of ``foreachBatch``."""
        self.batches.add(self.batches.name(batch_id, source), batch.select("image_id").distinct(), "matches", lambda: self.evaluator.match(self.data, batch).matches)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a streaming DataFrame of detections."""
        source = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
        return stream.writeStream.foreachBatch(lambda batch, n: self.update(batch, n, source)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def snapshot(self) -> Result:
        """The result over all batches so far; images not seen yet count as having no detections.

        Its tables, cells and slices are those of any other result; pairs, which need the boxes, aren't kept.
        """
        empty = self.data.gt.select(F.lit(0).cast("long").alias("dt_id"), "image_id", "category_id", F.lit(0.0).alias("score"), "bbox", "area", "ord", *[c for c in ("keypoints", "mask", "tight") if c in self.data.gt.columns]).where(F.lit(False))
        result = self.evaluator.match(self.data, empty)
        if self.batches.there("matches"):
            result.matches = self.batches.rows("matches", MATCHES)
        return result

    finalize = snapshot


class BackgroundEvaluator:
    """Takes batches on a bounded queue; one driver thread submits them in order."""

    def __init__(self, streaming, size: int = 8):
        self._streaming, self._queue, self._failed = streaming, queue.Queue(size), None
        self._thread = threading.Thread(target=self._work, daemon=True)
        self._thread.start()

    def _work(self) -> None:
        while (batch := self._queue.get()) is not None:
            if self._failed is None:
                try:
                    self._streaming.update(batch)
                except Exception as error:  # told at the next call
                    self._failed = error

    def _check(self) -> None:
        if self._failed is not None:
            raise self._failed

    def submit(self, batch: DataFrame, timeout: float | None = None) -> None:
        self._check()
        try:
            self._queue.put(batch, timeout=timeout)
        except queue.Full:
            raise QueueFull("no batch was taken in time") from None

    def finalize(self):
        self._queue.put(None)
        self._thread.join()
        self._check()
        return self._streaming.finalize()


class StreamingSums:
    """Panoptic and semantic streams: counts that add up, and the same rule for repeated images.

    ``count`` turns a batch's rows into rows of ``keys`` and summed columns.
    """

    def __init__(self, spark: SparkSession, path: str, count, keys: list[str]):
        self.count, self.keys, self.batches = count, keys, _Batches(spark, path)

    def update(self, batch: DataFrame, batch_id: int | None = None, source: str = "batch") -> None:
        self.batches.add(self.batches.name(batch_id, source), batch.select("image_id").distinct(), "counts", lambda: self.count(batch))

    def snapshot(self) -> DataFrame:
        rows = self.batches.rows("counts")
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in self.keys])

    finalize = snapshot
