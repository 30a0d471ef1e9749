"""A training corpus from ``documents``: filter, deduplicate, decontaminate, pack.

Each stage takes all that the one before has kept. Stages but the last return the columns of
``documents``; the last returns the pieces of the packed sequences. For all stages: a null text counts
as empty, a row without a doc_id is a document like any other, repeated rows are judged alike, whole
texts are read however long, further columns are carried along, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelyard.llm import decontamination, packing, quality, simhash, toxicity
from pixelyard.llm.common import staged, table

END_ID = 1


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go; equal texts stay or go together."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; equal texts stay or go together."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest doc_id, or the first of equal ones.

    Different texts of one doc_id both stay; texts without words are one group.
    """
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; an empty benchmark takes none."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences; an empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{i}")
    return docs
