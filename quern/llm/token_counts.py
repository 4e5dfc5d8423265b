"""Token counts through a cache keyed by digests of content and tokenizer version."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, common

CACHE = "version string, digest string, n_tokens bigint"
#: The compiled splitter's stack holds a run of white space of some 500,000 characters, not of a million.
#: Texts with a run of this many are split by the regex library, which gives the same pieces.
LONG_RUN = 100_000
_LONG_SPACE = re.compile(f"[{bpe.WHITE_SPACE}]{{{LONG_RUN}}}")


def version_digest(tokenizer: str, pattern: str) -> str:
    """Of the vocabulary file, the split pattern and the encoder: counts of another version are never taken."""
    parts = (bpe.file_digest(tokenizer), pattern, "tiktoken " + tiktoken.__version__)
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def counter(tokenizer: str, pattern: str):
    """A function from text to its number of tokens; special strings count as the one token they stand for."""
    enc = bpe.byte_level(tokenizer, pattern)
    special, plain, merge = enc.special_tokens_set, enc.encode_ordinary, enc._core_bpe.encode_single_piece
    split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    around = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else lambda text: [text]

    def count(text: str) -> int:
        if len(text) >= LONG_RUN and _LONG_SPACE.search(text):
            return sum(1 if part in special else sum(len(merge(p.encode())) for p in split(part)) for part in around(text) if part)
        if "<|" in text and any(s in text for s in special):
            return len(enc.encode(text, allowed_special="all"))
        return len(plain(text))

    return count


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first text of each digest within the task, deflated for the shuffle. Holds digests only."""
    seen: set[str] = set()
    for batch in batches:
        digests, texts = [], []
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                texts.append(zlib.compress(text.as_py().encode(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(texts, pa.binary())], names=["digest", "packed"])


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, cache_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text, however long; only texts that the cache lacks are
    encoded, once each. Columns other than doc_id and text are left aside, whatever their names.

    Content is normalised by taking null as the empty text, nothing else, as any other change
    could change counts. Misses are thinned to one a digest in each task before they are shuffled,
    so a text that fills a third of the rows sends one row a task; their counts are then appended
    to the Parquet table at cache_path, which later calls with the same tokenizer version read. Each
    call appends a folder of its own, so calls at the same time never touch each other's files.
    A call that fails after the append loses nothing: the next one finds those counts.
    Repeated rows are each returned; an empty table gives none.
    """
    spark = docs.sparkSession
    version = version_digest(tokenizer, pattern)
    keyed = docs.select("doc_id", common.text_or_empty().alias("_text")).select("doc_id", F.octet_length("_text").cast("bigint").alias("n_bytes"), F.sha2(F.col("_text").cast("binary"), 256).alias("digest"), "_text")
    misses = keyed.select("digest", "_text").mapInArrow(_first_seen, "digest string, packed binary")
    stored = _stored(spark, cache_path)
    if stored is not None:
        misses = misses.join(stored.where(F.col("version") == version).select("digest").distinct(), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(tokenizer, pattern), set()
        for batch in batches:
            digests, counts = [], []
            for digest, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    counts.append(count(zlib.decompress(packed.as_py()).decode()))
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(digests), pa.string()), pa.array(digests, pa.string()), pa.array(counts, pa.int64())], names=["version", "digest", "n_tokens"])

    misses.repartition("digest").mapInArrow(encode, CACHE).write.parquet(f"{cache_path}/call={uuid.uuid4().hex}")
    # Two calls at a time may both append a digest: their counts are equal. Grouped by both columns, the
    # counts are dealt anew for the join, whose shuffles Spark may split where one digest has many rows.
    counts = _stored(spark, cache_path).where(F.col("version") == version).groupBy("version", "digest").agg(F.max("n_tokens").alias("n_tokens")).drop("version")
    return keyed.drop("_text").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def shared_cache(spark: SparkSession, tokenizer: str, pattern: str) -> str:
    """The cache of this tokenizer version in the shared folder: calls and applications find it again."""
    return f"{common.shared_folder(spark)}/quern-token-counts-{version_digest(tokenizer, pattern)[:32]}"


def _stored(spark: SparkSession, cache_path: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CACHE).option("recursiveFileLookup", True).parquet(cache_path)
