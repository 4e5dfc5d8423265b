"""Exact top-k inner-product search by MaxScore over shards of integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import common

#: Exact integers of any size in an order that text keeps: shifted by this, in as many digits.
_SHIFT, _DIGITS = 10**640, 641
#: What stands for the exact score where it fits 64 bits: above every negative wide score, below every positive.
_NARROW = "1"
RESULT = "query_id bigint, vec_id bigint, score bigint, wide string"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the floor of scale times each component as a double (a whole number, which a double holds
    exactly); vectors that are null or hold null or non-finite components are left out, as are null
    ids and components that are infinite once multiplied. Repeated rows stay; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for vec_id, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not row.is_valid or row.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * row.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    rows.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["vec_id", "v"])

    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, "vec_id bigint, v array<double>")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles; shorter ones get zeros at their end."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), lengths[0])
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.float64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _size_class(x: np.ndarray) -> np.ndarray:
    """Per row 0, 1 or 2: products of two rows of class 0 sum to less than 2^53, of class 0 or 1 to less than
    2^63, so doubles, or 64-bit integers, hold every partial sum exactly."""
    most = np.abs(x).max(axis=1, initial=0)
    wide = max(1, x.shape[1])
    return (most >= (2.0**53 / wide) ** 0.5).astype(np.int64) + (most >= (2.0**62 / wide) ** 0.5)


def _exact(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


class Best:
    """The k best rows so far of each query, and the score below which a row can't be one of them."""

    def __init__(self, query_ids: np.ndarray, k: int, limit: np.ndarray | None = None):
        self.query_ids, self.k = query_ids, k
        self.limit: list = [None] * len(query_ids) if limit is None else [None if np.isnan(x) else int(x) for x in limit]
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(query_ids)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(query_ids)

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        ids, scores = np.concatenate([self.ids[i], ids]), np.concatenate([self.scores[i], scores])
        if len(ids) > self.k:
            order = sorted(range(len(ids)), key=lambda r: (-scores[r], ids[r]))[: self.k] if scores.dtype == object else np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[order], scores[order]
        self.ids[i], self.scores[i] = ids, scores
        if len(ids) == self.k:
            least = int(scores.min())
            if self.limit[i] is None or least > self.limit[i]:
                self.limit[i] = least


def search_block(best: Best, rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, step: int = 16) -> None:
    """Adds to best, for the queries at places `rows`, what a block of vectors holds for them.

    A query's terms are its components; a term's posting list is that component over the block, and its
    bound the most it can add above its least. The k-th best score so far parts the terms: those of small
    bounds, which even together can't lift a row from the least possible score to that score, are non-essential.
    The essential postings are traversed; the others are probed, largest bound first, for rows that can
    still reach the k-th best score. The arrays hold integers, as doubles, 64-bit or Python numbers.
    """
    postings = np.ascontiguousarray(vectors.T)
    low, high = postings.min(axis=1), postings.max(axis=1)
    a, b = queries * low, queries * high
    most, least = np.maximum(a, b), np.minimum(a, b)
    spread = most - least
    orders = np.argsort(spread, axis=1, kind="stable")
    below, floors = np.cumsum(np.take_along_axis(spread, orders, axis=1), axis=1), least.sum(axis=1)
    reach = {"f4": 2**24, "f8": 2**53, "i8": 2**62}.get(postings.dtype.str[1:])  # no score here is larger
    for i, own in enumerate(rows.tolist()):
        limit, order = best.limit[own], orders[i]
        if reach and limit is not None and abs(limit) > reach:
            if limit > 0:
                continue
            limit = None
        # Non-essential: the longest run of smallest bounds that stays below the limit.
        split = 0 if limit is None else int(np.searchsorted(below[i], limit - floors[i], side="left"))
        essential, probes = order[split:], order[:split][::-1]
        score = queries[i, essential] @ postings[essential] if len(essential) else np.zeros(len(ids), postings.dtype)
        left = most[i, probes].sum() if len(probes) else 0
        mine = ids != best.query_ids[own]
        found = np.flatnonzero(mine if limit is None else mine & (score + left >= limit))
        score = score[found]
        for at in range(0, len(probes), step):
            if not len(found):
                break
            terms = probes[at : at + step]
            score = score + queries[i, terms] @ postings[np.ix_(terms, found)]
            left = left - most[i, terms].sum()
            if limit is not None:
                alive = score + left >= limit
                found, score = found[alive], score[alive]
        if len(found) > best.k and score.dtype != object:  # the rest can't be among the k best of this block
            keep = score >= np.partition(score, len(score) - best.k)[len(score) - best.k]
            found, score = found[keep], score[keep]
        best.add(own, ids[found], score if score.dtype == object else score.astype(np.int64))


def search(best: Best, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, first_rows: int = 1024, block_rows: int = 16_384, step: int = 16) -> None:
    """Adds to best what these vectors hold for all its queries, block by block, first a small one that sets
    limits. Queries and rows meet by size
    class: doubles where they hold every sum, 64-bit integers where those do, Python's integers for the
    rows and queries beyond."""
    wide = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (queries, vectors))
    of_query, of_row = _size_class(queries), _size_class(vectors)
    for c in np.unique(of_query).tolist():
        rows = np.flatnonzero(of_query == c)
        for d in np.unique(of_row).tolist():
            kind = max(c, d)
            made = _exact if kind == 2 else lambda x, t=(np.float64, np.int64)[min(kind, 1)]: x.astype(t)
            if kind == 0 and float(np.abs(queries[rows]).max(initial=0)) * float(np.abs(vectors[of_row == d]).max(initial=0)) * max(1, wide) < 2.0**24:
                made = lambda x: x.astype(np.float32)
            q, members = made(queries[rows]), np.flatnonzero(of_row == d)
            small = first_rows if any(best.limit[i] is None for i in rows) else 0
            for part in np.split(members, [*range(small, len(members), block_rows)]):
                if len(part):
                    search_block(best, rows, q, ids[part], made(vectors[part]), step)


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, seed_rows: int = 1024, step: int = 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best rows of the shard (ids and scores), itself aside; ties to smaller ids."""
    best = Best(query_ids, k)
    search(best, queries, ids, vectors, seed_rows, step=step)
    for i, query_id in enumerate(query_ids.tolist()):
        yield query_id, best.ids[i], best.scores[i]


def _table(best: Best) -> pa.Table:
    counts = [len(x) for x in best.ids]
    scores = np.concatenate([np.zeros(0, np.int64), *best.scores])
    wide = [_NARROW] * len(scores)
    if scores.dtype == object:
        exact = scores.tolist()
        scores = np.array([max(-(2**63), min(2**63 - 1, s)) for s in exact], np.int64)
        wide = [_NARROW if s == c else str(s + _SHIFT).zfill(_DIGITS) for s, c in zip(exact, scores.tolist())]
    ids = np.concatenate([np.zeros(0, np.int64), *best.ids])
    return pa.table({"query_id": pa.array(np.repeat(best.query_ids, counts), pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64()), "wide": pa.array(wide, pa.string())})


def _at_most(limit: int | None) -> float | None:
    """A double that is not above the limit."""
    if limit is None or abs(limit) < 2**53:
        return limit
    if abs(limit) >= 2**1023:
        return 2.0**1023 if limit > 0 else None
    return float(np.nextafter(float(limit), -np.inf))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = 131_072, query_rows: int = 32_768, seed_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows of vectors (vec_id, v).

    Vectors are dealt once into shards by a hash, and stay there; queries come to them in blocks of about
    query_rows, each broadcast (64 dimensions: 16 MB) with limits that a pre-pass has set: the k-th best
    score among seed_rows rows chosen by a hash, which all shards prune by from their first row. A shard keeps k rows a
    query, and these alone are merged; every block's are appended to a table in the shared folder.
    A query's own row is never its result; of repeated vec_ids all rows are taken for its own, and the
    query is answered once. Ties go to smaller vec_ids. All rows are returned where there are fewer than k.
    Vectors of unequal length meet as if the shorter had zeros at its end. Components and sums of any
    size are ranked exactly; a score beyond 64 bits is reported as the largest or smallest 64-bit number.
    Empty table: no rows.
    """
    spark = vectors.sparkSession
    n, n_queries = vectors.select(F.count("*"), F.count_if(is_query)).first()
    blocks = max(1, -(-n_queries // query_rows))
    # At least two shards a core while they have 4096 rows, so that few rows are spread too.
    shards = max(1, -(-n // shard_rows), min(2 * spark.sparkContext.defaultParallelism, n // 4096))
    placed = common.cut(vectors.select("vec_id", "v").repartition(shards, F.xxhash64("vec_id", "v")), "vectors")
    chosen = placed.where(common.share_below(seed_rows / max(1, n), F.col("vec_id"), F.col("v"))).select("vec_id", F.col("v").cast("array<double>").alias("v")).toArrow()
    seeds = spark.sparkContext.broadcast((chosen["vec_id"].to_numpy(), matrix(chosen["v"])))

    def pre_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = seeds.value
        for batch in batches:
            best = Best(batch.column(0).to_numpy(), k)
            if len(ids):
                search(best, matrix(batch.column(1)), ids, rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(_at_most, best.limit), pa.float64())], names=["query_id", "q", "limit"])

    asked = vectors.where(is_query).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("v").cast("array<double>").alias("q"))
    asked = common.cut(asked.mapInArrow(pre_pass, "query_id bigint, q array<double>, limit double").withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "queries")
    path = common.scratch_path(spark, "best")
    for number in range(blocks):
        block = asked.where(F.col("_block") == number).drop("_block").toArrow()
        limit = block["limit"].to_numpy(zero_copy_only=False).astype(np.float64)
        sent = spark.sparkContext.broadcast((block["query_id"].to_numpy(), matrix(block["q"]), limit))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query_ids, queries, limit = sent.value
            best = Best(query_ids, k, limit)
            for batch in batches:
                if batch.num_rows and len(query_ids):
                    search(best, queries, batch.column(0).to_numpy(), matrix(batch.column(1)))
            yield from _table(best).to_batches()

        placed.select("vec_id", F.col("v").cast("array<double>")).mapInArrow(run, RESULT).write.mode("append").parquet(path)
        sent.unpersist()
    part = spark.read.schema(RESULT).parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("wide").desc(), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
