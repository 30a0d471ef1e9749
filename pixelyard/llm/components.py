"""Connected components by alternating large and small stars, a few shuffles of edges a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelyard.llm.common import Scratch

#: Rounds grow with the logarithm of the node count; more than this means a fault.
MOST_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its least neighbour to its larger neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its least smaller neighbour to its other smaller neighbours and takes it itself."""
    down = edges.where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    handed = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("double") - F.col("b"))).first())


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a long, b long)`` that isn't its component's least node.

    The least node of a component is its root. Loops and repeated edges have no effect; no edges give
    no rows. Each round's table goes when the next is written; the last one is the ``scratch``'s.
    """
    scratch, own = scratch or Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    now = own.stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        now = own.stage(_small_star(_large_star(now)), "edges")
        own.drop(but=1)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components didn't settle")
    scratch.paths += own.paths
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
