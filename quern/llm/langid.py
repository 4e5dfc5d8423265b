"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import common

UNDETERMINED = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Code points that are scored at a time; longer texts are cut with an overlap, so no n-gram is lost.
SEGMENT = 400_000
_BLOCK = 1024
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """log_prob: one row per bucket and a last row of zeros for n-grams that cross a border; a column per language."""

    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray


def _segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts one after another, each between two blanks and followed by
    a zero; the segment that each starts in, the text of each segment, and how many n-grams start in it."""
    reach = max(ORDERS) - 1
    parts, owner, core = [], [], []
    for i, text in enumerate(texts):
        whole = f" {text.lower()} "
        for at in range(0, len(whole), SEGMENT):
            part = whole[at : at + SEGMENT + reach]
            parts.append(part)
            owner.append(i)
            core.append(min(SEGMENT, len(whole) - at))
    points = np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    return points, lengths, np.array(owner, np.int64), np.array(core, np.int64)


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point; BUCKETS where it would cross a border."""
    h = np.full(points.shape, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
    bad = np.zeros(points.shape, bool)
    n = len(points)
    with np.errstate(over="ignore"):
        for k in range(order):
            here = points[k:]
            h[: n - k] = (h[: n - k] ^ here) * np.uint32(0x01000193)
            h[: n - k] ^= h[: n - k] >> np.uint32(15)
            bad[: n - k] |= here == 0
            bad[n - k :] = True
        h *= np.uint32(0x85EBCA6B)
    out = (h >> np.uint32(32 - 15)).astype(np.int32)
    out[bad] = BUCKETS
    return out


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SEGMENT code points together."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SEGMENT:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _mask_overlap(found: np.ndarray, lengths: np.ndarray, core: np.ndarray) -> None:
    """N-grams that start in the overlap of a cut text belong to the next segment."""
    starts = np.concatenate([[0], lengths.cumsum()[:-1]])
    for s, size, own in zip(starts, lengths, core):
        if size - 1 > own:
            found[s + own : s + size] = BUCKETS


def log_likelihood(texts: list[str], model: Model) -> np.ndarray:
    """A row per text, a column per language."""
    out = np.zeros((len(texts), len(model.langs)))
    for lo, hi in _batches(texts):
        points, lengths, owner, core = _segments(texts[lo:hi])
        starts = np.concatenate([[0], lengths.cumsum()[:-1]])
        sums = np.zeros((len(lengths), len(model.langs)))
        for order in ORDERS:
            found = grams(points, order)
            _mask_overlap(found, lengths, core)
            sums += np.add.reduceat(model.log_prob.take(found, axis=0), starts, axis=0, dtype=np.float64)
        np.add.at(out, lo + owner, sums)
    return out


def counts(texts: list[str]) -> np.ndarray:
    """How often each bucket occurs in all texts together."""
    out = np.zeros(BUCKETS + 1, np.int64)
    for lo, hi in _batches(texts):
        points, lengths, _, core = _segments(texts[lo:hi])
        for order in ORDERS:
            found = grams(points, order)
            _mask_overlap(found, lengths, core)
            out += np.bincount(found, minlength=BUCKETS + 1)
    return out[:BUCKETS]


def train(docs: DataFrame, may_learn: Column, max_docs_per_lang: int = 5000, alpha: float = 0.1, max_langs: int = 500) -> Model:
    """Learns from text and lang of rows where may_learn holds and neither is null.

    At most about max_docs_per_lang whole texts of each language are taken, by a hash of doc_id
    and text; where there are fewer, all. Counts are summed in each task, then by language and
    block of buckets, so the driver gets max_langs x BUCKETS numbers at most. Of more languages the
    max_langs that most rows have are learned (of equally frequent ones, those that sort first).
    Repeated rows count each; an empty table, or one without a row to learn from, gives a model of `und` alone.
    """
    known = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("lang", F.col("lang").cast("string"))
    most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    if not sizes:
        return Model([UNDETERMINED], np.zeros(1), np.zeros((BUCKETS + 1, 1), np.float32))
    share = {lang: max_docs_per_lang / n for lang, n in sizes.items() if n > max_docs_per_lang}
    if share:
        bound = F.create_map(*[F.lit(x) for lang, f in share.items() for x in (lang, int(f * (1 << 30)))])
        known = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.coalesce(F.try_element_at(bound, F.col("lang")), F.lit(1 << 30)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                found = counts([t for t, own in zip(texts, langs) if own == lang])
                total[lang] = total[lang] + found if lang in total else found
        for lang, found in total.items():
            blocks = [found[i : i + _BLOCK] for i in range(0, BUCKETS, _BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(blocks)), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.list_(pa.int64()))], names=["lang", "block", "n"]
            )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "block": [group["block"].iloc[0]], "n": [np.sum(group["n"].to_list(), axis=0)]})

    kind = "lang string, block int, n array<bigint>"
    learned = F.broadcast(known.sparkSession.createDataFrame([(x,) for x in sizes], "lang string"))
    rows = known.join(learned, "lang", "left_semi").select("lang", F.col("text").cast("string")).mapInArrow(partial, kind).groupBy("lang", "block").applyInPandas(add, kind).collect()
    langs = sorted(sizes)
    column = {lang: i for i, lang in enumerate(langs)}
    table = np.zeros((BUCKETS, len(langs)))
    for r in rows:
        table[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK, column[r["lang"]]] = r["n"]
    smooth = table + alpha
    log_prob = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    log_prob[:BUCKETS] = np.log(smooth / smooth.sum(axis=0))
    prior = np.array([sizes[x] for x in langs], float)
    return Model(langs, np.log(prior / prior.sum()), log_prob)


def predict(docs: DataFrame, model: Model, keep: list[str], out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep, with lang_pred and score (named as out says), from the whole text alone.

    score is the posterior probability of lang_pred, at most 1. A text that is null or has no
    letter gets `und` with score 0. Ties go to the language that sorts first. Repeated rows are
    each scored; an empty table gives no rows. A long text is scored whole, SEGMENT code points at a
    time. Columns in keep may have any names but those in out. The model is broadcast: languages x 128 KiB.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    own = "text" in keep and kept.schema["text"].dataType.typeName() == "string"
    whole = "text" if own else common.free_names(kept, "_whole_text")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(whole).to_pylist()]
            has = np.array([_LETTER.search(t) is not None for t in texts], bool)
            score = np.zeros(len(texts))
            best = np.zeros(len(texts), np.int64)
            if has.any():
                ll = log_likelihood([t for t, x in zip(texts, has) if x], m) + m.log_prior
                best[has] = ll.argmax(axis=1)
                score[has] = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
            langs = [m.langs[i] if x else UNDETERMINED for i, x in zip(best, has)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(score)], names=[*names, *new])

    names, new = kept.columns, list(out)
    schema = docs.select(*keep).schema.add(new[0], "string").add(new[1], "double")
    sent_columns = kept if own else docs.select(F.col("text").cast("string").alias(whole), *keep)
    return sent_columns.mapInArrow(run, schema)
