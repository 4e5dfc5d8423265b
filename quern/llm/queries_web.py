"""Queries op1 and op3: HTML extraction and WARC archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, html_text, warc


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(common.table(spark, sf_dir, "pages"), payloads=False)
    return captures.select("page_id", "payload_bytes", "payload_digest", F.col("record.type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
     f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extract_pages(common.table(spark, sf_dir, "pages"), ["page_id", "url"])
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))
