"""Packing and token counts against the tokenizers library."""

import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import bpe, packing, token_counts

TEXTS = ["", " ", "a", "Hello, WORLD's  end\n\n\tx", "É́ ﬁn ΑΣ ΣΑΣ.", "<|endoftext|> x<|startoftext|>y <|nope|>", "\x1c a\x1cb\x1f", "日本語 text 12345 ½", "don't we'll I'M", "a  \n b   ", "x" * 5000, "​ y", "😀😀 ok"]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids(raw: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@pytest.mark.parametrize("text", TEXTS)
def test_word_end_ids(word, text):
    assert ids(bpe.word_end(P.path("word_bpe_49k.json")).encode(text)) == word.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_byte_counts(byte, text):
    count = token_counts.counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    assert count(text) == len(byte.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=60))
def test_random_texts(text):
    w, b = Tokenizer.from_file(P.path("word_bpe_49k.json")) if not hasattr(test_random_texts, "w") else test_random_texts.w, None
    test_random_texts.w = w
    if any(not c.isprintable() and not c.isspace() for c in text):
        return  # the libraries' Unicode versions differ on unassigned characters
    assert ids(bpe.word_end(P.path("word_bpe_49k.json")).encode(text)) == w.encode(text, add_special_tokens=False).ids


def test_corpus_ids(spark, word, byte):
    count = token_counts.counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    enc = bpe.word_end(P.path("word_bpe_49k.json"))
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert ids(enc.encode(row.text)) == word.encode(row.text, add_special_tokens=False).ids
        assert count(row.text) == len(byte.encode(row.text, add_special_tokens=False).ids)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 4000)])
def test_pack_keeps_every_capacity(rule, caps):
    lengths = np.random.default_rng(1).integers(1, 60, 500)
    limit = packing.Capacities(*caps, rule=rule)
    bins, offset, n = packing.pack(lengths, limit)
    assert bins.max() + 1 == n
    for b in range(n):
        own = lengths[bins == b]
        assert own.sum() <= caps[0] and len(own) <= caps[1] and (own * own).sum() <= caps[2]
        order = np.argsort(offset[bins == b])
        assert (offset[bins == b][order] == np.concatenate([[0], own[order].cumsum()[:-1]])).all()
    if rule == "norm" and caps[1] == 100 and caps[2] == 10_000:
        assert n <= -(-lengths.sum() // 100) * 1.03 + 1


def test_pack_rejects_oversized():
    with pytest.raises(ValueError):
        packing.pack(np.array([101]), packing.Capacities(100, 9, 10**6))


SCHEMA = "doc_id bigint, text string, piece int, length string"


def test_pack_documents_edges(spark, word):
    rows = [(1, None, 9, "x"), (2, "", 9, None), (3, "one two " * 4000, 1, "y"), (4, "same", 0, ""), (4, "same", 0, ""), (None, "no id", 0, "")]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), P.path("word_bpe_49k.json")).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.piece, r.length) for r in by[1]] == [(0, 1)] and by[1][0].ids_crc32 == zlib.crc32(b"\0\0\0\0")
    assert len(by[4]) == 2 and len(by[None]) == 1
    whole = word.encode(rows[2][1], add_special_tokens=False).ids + [0]
    for k, r in enumerate(sorted(by[3], key=lambda r: r.piece)):
        cut = whole[2048 * k : 2048 * (k + 1)]
        assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 2048 * k, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut)))
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json")).count() == 0


def test_count_tokens_uses_the_cache(spark, tmp_path, byte):
    path = f"file://{tmp_path}/cache"
    schema = "doc_id bigint, text string, digest string, n_tokens int"
    rows = [(i, t, "d", 0) for i, t in enumerate([*TEXTS, None, "again", "again"])]
    docs = spark.createDataFrame(rows, schema)
    args = (P.path("byte_bpe_50k.json"), P.PATTERN, path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, *args).collect()}
    assert got == {i: (len((t or "").encode()), len(byte.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in rows}
    stored = spark.read.parquet(path).count()
    assert stored == len({t or "" for _, t, _, _ in rows})
    more = spark.createDataFrame([*rows, (99, "new text", "", 0)], schema)
    assert token_counts.count_tokens(more, *args).count() == len(rows) + 1
    assert spark.read.parquet(path).count() == stored + 1
    assert token_counts.count_tokens(docs.limit(0), *args).count() == 0


def test_long_runs_of_white_space(byte):
    count = token_counts.counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    for text in ("a" + " " * 2_000_000 + "b c", "\n" * 1_000_000, "x" + "\t" * 200_000 + "\ny<|endoftext|>" + " " * 600_000 + "<|endoftext|> z", "　" * 150_000 + " é 12"):
        assert count(text) == len(byte.encode(text, add_special_tokens=False).ids)


def test_the_query_reads_the_cache_of_earlier_calls(spark, byte, monkeypatch):
    from quern.llm import common
    from quern.llm.queries_tokens import op10_token_counts

    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: len(byte.encode(r.text, add_special_tokens=False).ids) for r in common.table(spark, sf, "documents").collect()}
    assert {r.doc_id: r.n_tokens for r in op10_token_counts(spark, sf).collect()} == want
    cache = token_counts.shared_cache(spark, P.path("byte_bpe_50k.json"), P.PATTERN)
    stored = spark.read.parquet(cache).count()
    assert {r.doc_id: r.n_tokens for r in op10_token_counts(spark, sf).collect()} == want
    assert spark.read.parquet(cache).count() == stored
    # What the cache says is taken: a count put there for a new text is what the query's operator returns.
    docs = spark.createDataFrame([(1, "a text that no table holds")], "doc_id bigint, text string")
    version = token_counts.version_digest(P.path("byte_bpe_50k.json"), P.PATTERN)
    digest = docs.selectExpr("sha2(text, 256) AS d").first().d
    spark.createDataFrame([(version, digest, 77)], token_counts.CACHE).write.parquet(f"{cache}/call=by-hand")
    got = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN, cache).collect()
    assert [r.n_tokens for r in got] == [77]


def fewest(lengths, limit):
    """The least number of bins of these lengths, by trying every way."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best and i < len(lengths):
            return
        if i == len(lengths):
            best = min(best, len(bins))
            return
        for k in range(len(bins)):
            if bins[k][0] + lengths[i] <= limit.tokens and bins[k][1] < limit.documents and bins[k][2] + lengths[i] ** 2 <= limit.attention:
                place(i + 1, [*bins[:k], (bins[k][0] + lengths[i], bins[k][1] + 1, bins[k][2] + lengths[i] ** 2), *bins[k + 1 :]])
        place(i + 1, [*bins, (lengths[i], 1, lengths[i] ** 2)])

    place(0, [])
    return best


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(20, 20, 400), (20, 3, 400), (20, 20, 220)])
def test_pack_against_every_way_of_packing(rule, caps):
    rng = np.random.default_rng(caps[1] + caps[2])
    over = 0
    for _ in range(40):
        lengths = rng.integers(1, 14, 8)
        limit = packing.Capacities(*caps, rule=rule)
        n = packing.pack(lengths, limit)[2]
        least = fewest(sorted(lengths.tolist(), reverse=True), limit)
        assert least <= n <= least + 1
        over += n > least
    assert over <= 8
