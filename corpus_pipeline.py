"""A corpus pipeline: language ID, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return
rows of `documents`, all columns; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import langid, packing, quality, simhash
from palimpsest.llm.common import delete, scratch, shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text has letters and lies near a centroid of some language."""
    return langid.accepted(docs, langid.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that no rule of the cascade rejects."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates: the one with the smallest id."""
    return simhash.deduplicated(docs, shingle=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pack", pack)]

#: Language ID, fingerprints and token ids are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and reread as the next one's docs.

    What a stage leaves in shared folders goes once its result is written, and so does the result once the next is.
    """
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        delete(spark, *held)
        docs, held = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
