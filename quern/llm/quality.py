"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import common

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "marks", "ends_marked", "distinct_words",
    "top_word", "distinct_pairs", "log_line", "repeated_lines", "symbols", "one_symbol",
)
FOLDS = 4
_MARKS = b"!\"'(),-.:;?"
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text, whatever its language; all are finite, for an empty text too."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = int((points != low).sum()) if len(low) == n else sum(map(str.isupper, text))
    ascii_counts = np.bincount(points[points < 128], minlength=128)
    digits = int(ascii_counts[48:58].sum())
    marks = int(ascii_counts[list(_MARKS)].sum())
    symbol_counts = ascii_counts[list(_SYMBOLS)]
    symbols = int(symbol_counts.sum())
    words = text.split()
    w = len(words)
    counts = Counter(words)
    lines = text.split("\n")
    return [
        log1p(n), log1p(w), (n - w) / max(1, w), upper / n, digits / n, marks / n,
        sum(1 for x in words if not x[-1].isalnum()) / max(1, w),
        log1p(len(counts)) / log1p(w) if w else 0.0,
        max(counts.values()) / w if w else 0.0,
        len(set(zip(words, words[1:]))) / max(1, w - 1),
        log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), symbols / n, int(symbol_counts.max()) / n,
    ]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and `stats`, of every whole text; null counts as empty. Repeated rows are each
    described; an empty table gives no rows. Columns in keep may have any names but stats."""
    mine = common.free_names(docs.select(*keep), "_whole_text")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names[1:], "stats"])

    from pyspark.sql.types import ArrayType, DoubleType

    return docs.select(F.col("text").cast("string").alias(mine), *keep).mapInArrow(run, docs.select(*keep).schema.add("stats", ArrayType(DoubleType())))


@dataclass(frozen=True)
class Model:
    """Standardisation, random directions and phases, ridge weights, and the calibration's points."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    probability: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(stats) @ self.weights, self.raw, self.probability), 0, 1)


def pool_adjacent(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The non-decreasing means closest to total / weight by weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, t in zip(weight.tolist(), total.tolist()):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), t / w) for w, t, n in blocks])


def sample_labels(labels: DataFrame, may_learn: Column, max_rows: int = 200_000) -> DataFrame:
    """doc_id and _y of the labels (doc_id, quality) that are 0 or 1 and where may_learn holds for doc_id:
    at most about max_rows, chosen by a hash of doc_id; where there are fewer, all. They are few
    enough to be broadcast (16 bytes each)."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & may_learn).select("doc_id", F.col("quality").cast("double").alias("_y"))
    count = marked.count()
    return marked.where(common.share_below(max_rows / max(1, count), F.col("doc_id")))


def train(stats: DataFrame, marked: DataFrame, size: int = 256, gamma: float = 0.03, ridge: float = 3e-4, seed: int = 5) -> Model:
    """Fits on documents (doc_id, stats) that sample_labels() marks. Their rows are cut to a table first, so
    the statistics of all documents are read once, by as many tasks as they have parts. Every task sums its part of the normal
    equations, for each of FOLDS folds; the sums are added by matrix row. Scores for the calibration
    come from models that have not seen the row's fold; their counts reach the driver in at most
    3001 steps. With no label of either kind every score is the share of label 1 (0.5 if there is none at all).
    A document that occurs or is labelled several times counts as often; ties at a step of the calibration
    are pooled; with an empty table every score is 0.5.
    """
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = common.cut(stats.join(F.broadcast(marked), "doc_id").select("stats", "_y", fold), "labelled")
    d = len(STATISTICS)
    moments = rows.select(F.count("*"), F.coalesce(F.avg("_y"), F.lit(0.5)), *[F.coalesce(f(F.col("stats")[i]), F.lit(0.0)) for f in (F.avg, F.stddev_pop) for i in range(d)]).first()
    n, share = moments[0], float(moments[1])
    rng = np.random.default_rng(seed)
    mean, scale = np.array(moments[2 : 2 + d]), np.maximum(np.array(moments[2 + d :]), 1e-9)
    shape = Model(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (d, size)), rng.uniform(0, 2 * np.pi, size), np.zeros(size + 1), np.zeros(1), np.array([share]))
    if not n or share in (0.0, 1.0):
        return shape
    m = size + 1
    kind = "fold int, i int, sums array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, m, m + 1))
        for batch in batches:
            z = shape.features(np.array(batch.column(0).to_pylist()).reshape(-1, d))
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f in range(FOLDS):
                own = z[fold == f]
                sums[f] += own.T @ np.hstack([own, y[fold == f, None]])
        for f in range(FOLDS):
            if sums[f].any():
                yield pa.RecordBatch.from_arrays([pa.array([f] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(list(sums[f]), pa.list_(pa.float64()))], names=["fold", "i", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [group["fold"].iloc[0]], "i": [group["i"].iloc[0]], "sums": [np.sum(group["sums"].to_list(), axis=0)]})

    # The sample is bounded, so 16 tasks hold it; each sends FOLDS x 257 rows of 2 KB.
    folds = np.zeros((FOLDS, m, m + 1))
    for r in rows.coalesce(16).mapInArrow(partial, kind).groupBy("fold", "i").applyInPandas(add, kind).toLocalIterator():
        folds[r["fold"], r["i"]] = r["sums"]

    def solve(sums: np.ndarray) -> np.ndarray:
        penalty = np.eye(m) * (ridge * max(1.0, sums[-1, -2]) + 1e-9)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(sums[:, :m] + penalty, sums[:, m])

    every = folds.sum(axis=0)
    others = np.stack([solve(every - folds[f]) for f in range(FOLDS)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = shape.features(np.array(batch.column(0).to_pylist()).reshape(-1, d))
            raw = (z * others[batch.column(2).to_numpy()]).sum(axis=1)
            step = np.rint((np.clip(raw, -1, 2) + 1) * 1000).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(1)], names=["step", "y"])

    steps = rows.mapInArrow(binned, "step int, y double").groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("s")).orderBy("step").collect()
    weight, total = np.array([r.n for r in steps], float), np.array([r.s for r in steps], float)
    fitted = pool_adjacent(weight, total)
    raw = np.array([r.step for r in steps]) / 1000 - 1
    return Model(mean, scale, shape.directions, shape.phases, solve(every), raw, fitted)


def score(stats: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep and score (0 to 1, higher: label 1 is likelier), from stats alone. Each row is
    scored, repeated ones too; an empty table gives no rows. Columns in keep may have any names but score."""
    mine = common.free_names(stats.select(*keep), "_stats")[0]
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.score(np.array(batch.column(0).to_pylist(), float).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found)], names=[*batch.schema.names[1:], "score"])

    return stats.select(F.col("stats").alias(mine), *keep).mapInArrow(run, stats.select(*keep).schema.add("score", "double"))


def score_texts(docs: DataFrame, model: Model, out: str) -> DataFrame:
    """docs with the score of every whole text as column out (a name that docs lacks), in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.as_py() or "") for t in batch.column("text")]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(rows))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, docs.select("*").schema.add(out, "double"))
