"""Queries op4, op5 and op10: packing, byte-level BPE and token counts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, duck_bpe, packing, token_counts


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokenizer, pattern = common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    counts = token_counts.count_tokens(docs, tokenizer, pattern, token_counts.shared_cache(spark, tokenizer, pattern))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duck_bpe.digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
