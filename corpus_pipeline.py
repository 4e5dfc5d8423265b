"""Corpus preparation: language ID, quality, near-duplicates, packing.

Each stage's result is written as Parquet in the shared folder and read again as the next one's
documents, so a lost executor never costs more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import common, stages

STAGES = [
    ("language_id", stages.language_id),
    ("quality_classifier", stages.quality_classifier),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("best_fit_packing", stages.best_fit_packing),
]

#: SQL can't express the trained stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table: one row per packed piece."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return docs
