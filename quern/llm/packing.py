"""Best-fit packing of token pieces into sequences under several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bpe

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, grp bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


@dataclass(frozen=True)
class Capacities:
    """What one sequence holds at most. attention is the sum of squared piece lengths.

    With the defaults only tokens bind: a piece has at least one token, so no sequence holds more than 2048
    pieces, and squared lengths sum to at most the square of their sum. A document cap below tokens, or
    an attention cap below tokens squared, binds. weights: of the tokens, documents and attention left
    over, each as a share of its capacity.
    rule: "norm" takes the bin with the least weighted norm of what is left after the piece;
    "dot" the one with the largest weighted dot product of the piece and what is left before it.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    rule: str = "norm"


def pack(lengths: np.ndarray, caps: Capacities) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins: longest first, each into the bin of
    the best score among all open bins where every capacity still suffices, else a new one.

    Every open bin is scored; a bin leaves the list only when no piece that is left fits its tokens.
    """
    n = len(lengths)
    size = np.stack([lengths, np.ones(n, np.int64), lengths * lengths]).astype(np.int64)
    limit = np.array([caps.tokens, caps.documents, caps.attention], np.int64)
    if n and (size > limit[:, None]).any():
        raise ValueError("a piece is larger than an empty sequence")
    share = np.sqrt(np.array(caps.weights)) / limit
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((3, 64), np.int64)
    names = np.zeros(64, np.int64)
    open_n = bins = 0
    least = int(lengths.min()) if n else 0
    dead = 0
    for i in order.tolist():
        item = size[:, i]
        best = -1
        if open_n:
            rest = left[:, :open_n] - item[:, None]
            fits = np.flatnonzero((rest >= 0).all(axis=0))
            if fits.size:
                if caps.rule == "norm":
                    scaled = rest[:, fits] * share[:, None]
                    best = fits[np.argmin((scaled * scaled).sum(axis=0))]
                else:
                    best = fits[np.argmax(((left[:, fits] * share[:, None]) * (item * share)[:, None]).sum(axis=0))]
        if best < 0:
            if item[0] + least > caps.tokens:  # full at once: it is never open
                bin_of[i], bins = bins, bins + 1
                continue
            if open_n == names.size:
                left = np.concatenate([left, np.zeros_like(left)], axis=1)
                names = np.concatenate([names, np.zeros_like(names)])
            best, open_n = open_n, open_n + 1
            left[:, best], names[best] = limit, bins
            bins += 1
        bin_of[i], offset[i] = names[best], caps.tokens - left[0, best]
        left[:, best] -= item
        if left[0, best] < least or left[1, best] < 1:
            dead += 1
            if dead > 32:
                keep = np.flatnonzero((left[0, :open_n] >= least) & (left[1, :open_n] >= 1))
                open_n, dead = keep.size, 0
                left[:, :open_n], names[:open_n] = left[:, keep], names[keep]
    return bin_of, offset, bins


def pieces(docs: DataFrame, tokenizer: str, groups: int, size: int, end_id: int = 0) -> DataFrame:
    """Tokens of each whole text with end_id after them, cut into pieces of at most size tokens.

    A null text is empty and gives one piece that is the end id alone. Each document goes to one of
    `groups` groups by a hash of its id, its tokens and how many such rows the task has seen: copies
    and repeated rows spread evenly, and a task that runs again deals the same, whatever the rows' order.
    A task keeps a number for each distinct row of its part of the table (some 100 bytes), never a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = bpe.word_end(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1)):
                tokens = encoder.encode(text.as_py() or "") + end
                key = b"%d:%d" % (doc_id or 0, zlib.crc32(tokens))
                own = xxhash.xxh64_intdigest(key)
                nth = seen[own] = seen.get(own, -1) + 1
                grp = zlib.crc32(b"%s:%d:%d" % (key, part, nth) if nth else key) % groups
                for k, at in enumerate(range(0, len(tokens), 4 * size)):
                    cut = tokens[at : at + 4 * size]
                    out.append((doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut), grp))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "grp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, caps: Capacities = Capacities(), group_docs: int = 4096) -> DataFrame:
    """One row per piece with its sequence and its place there; nothing is dropped.

    docs needs doc_id and text; other columns are left aside. Only pieces (about 50 bytes each)
    are shuffled, never texts. Documents are dealt evenly over ceil(rows / group_docs) groups,
    and each group is packed by itself, so a task's memory does not grow with the corpus; that
    costs at most about one part-filled sequence a group. A document cap under 1 or an attention
    cap under tokens squared also bounds the pieces' size.
    Null text: one piece with the end id. A very long text is encoded whole and gives as many pieces as it
    needs, all in one group. Equal lengths are packed in the order they come in. Repeated rows: each is packed. Empty table: no rows.
    """
    size = min(caps.tokens, int(caps.attention**0.5))
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, tokenizer, groups, size)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bins, offset, n = pack(group["length"].to_numpy(np.int64), caps)
        grp = int(group["grp"].iloc[0])
        return group.assign(sequence_id=grp * (1 << 32) + bins, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return cut.groupBy("grp").applyInPandas(run, PACKED)
