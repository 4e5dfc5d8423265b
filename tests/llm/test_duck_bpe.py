"""DuckDB BPE against tiktoken, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quern.llm import bpe, duck_bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.tiktoken_ranks(RANKS), special_tokens={})


def test_texts(tik):
    rng = random.Random(3)
    texts = ["", " ", "\n\n \t x", "don't we'll", "aaaa" * 3000, "=" * 777, "ab" * 500 + "b" * 9, "日本語" * 60, "<|endoftext|> \x1c a\x1cb \x85\xa0 z  ", "😀 12345 ½", "".join(rng.choices("abcdeéß", k=3000)), "".join(rng.choices("ab", k=400)), "".join(chr(rng.randrange(1, 0x3000)) for _ in range(800))]
    codec = duck_bpe.codec(RANKS, P.PATTERN)
    for (ids, back), text in zip(codec.code(texts), texts):
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
        assert back == text.encode()


def test_both_queries_agree(tik):
    rng = random.Random(5)
    words = [bytes(rng.choices(b"aabcdethinors", k=rng.randrange(1, 40))) for _ in range(600)]
    duck = duck_bpe.codec(RANKS, P.PATTERN).duck
    for sql in (duck_bpe.CONTRACT, duck_bpe.LONG):
        assert [np.frombuffer(x, "<u4").tolist() for x in duck._merge(words, sql)] == [tik._core_bpe.encode_single_piece(w) for w in words]
    with pytest.raises(ValueError):
        duck.decode_words([(50256).to_bytes(4, "little")])


def test_corpus(spark, tik):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in duck_bpe.digests(docs, RANKS, P.PATTERN, ["doc_id"]).collect()}
    for row in docs.collect():
        want = tik.encode_ordinary(row.text)
        r = got[row.doc_id]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


def test_edges(spark):
    schema = "doc_id bigint, text string, ids string, n_tokens int"
    rows = [(1, None, "", 0), (1, None, "", 0), (None, "a b", None, None), (3, "", "", 0)]
    got = duck_bpe.encode_and_decode(spark.createDataFrame(rows, schema), RANKS, P.PATTERN, ["doc_id"], batch_chars=2).collect()
    assert sorted(bytes(r.decoded) for r in got) == [b"", b"", b"", b"a b"] and sorted(len(r.ids) for r in got) == [0, 0, 0, 2]
    assert duck_bpe.digests(spark.createDataFrame([], schema), RANKS, P.PATTERN, ["doc_id"]).count() == 0
