"""Queries op2 and op8: fingerprints and near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, fingerprint, neighbours, simhash


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every whole text of docs (doc_id, text; null: empty) with its sketch, its edited text's, and the
    next document's: the document after it by descending doc_id, and after the last the first.

    The edited text has the last half of the code points (rounded down) replaced by the first as many
    of the next document, or by all of it if it is shorter. Rows with one doc_id are ordered by text;
    a null doc_id comes last. A single row is its own next document, an empty table gives no rows,
    long texts are taken whole, and columns other than doc_id and text are left aside, whatever their names.
    Texts are shuffled once, by ranges of doc_id and text.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), common.text_or_empty().cast("string").alias("text"))
    paired, window = neighbours.with_next(rows, "doc_id", "text", {"_next": "text"})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    edited_rows = paired.select("doc_id", "_ghost", "_range", "text", n.cast("bigint").alias("n_chars"), edited.alias("_edited"))
    sketched = fingerprint.fingerprint(fingerprint.fingerprint(edited_rows, "text", "sketch"), "_edited", "edited_sketch")
    following = sketched.withColumn("next_sketch", F.lead("sketch").over(window))
    return neighbours.drop_ghosts(following).withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256)).drop("_edited", "text")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(common.table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint.to_text(F.col("sketch")).alias("fingerprint"), fingerprint.to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
