"""Queries op7 and op9: language ID and the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, langid, quality


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", common.crc_of("doc_id") % 3 == 1)
    return langid.predict(docs, langid.train(docs, ~F.col("held_out")), ["doc_id", "held_out"])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.crc_of("doc_id") % 5 == 0
    stats = common.cut(quality.with_statistics(common.table(spark, sf_dir, "documents"), ["doc_id"]), "statistics")
    model = quality.train(stats, quality.sample_labels(common.table(spark, sf_dir, "labels"), ~held_out))
    scored = quality.score(stats, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
