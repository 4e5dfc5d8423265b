"""MaxScore against brute force, with ties, repeats, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import maxscore


def brute(queries, rows, k):
    out = {}
    for q, v in queries.items():
        found = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


@pytest.mark.parametrize("spread", [1, 64, 3_000_000])
@pytest.mark.parametrize("k", [1, 7, 50])
def test_shard(spread, k):
    rng = np.random.default_rng(k)
    vectors = rng.integers(-spread, spread + 1, (300, 24))
    vectors[100:200] = vectors[100]
    ids = rng.permutation(1000)[:300]
    got = {q: list(zip(i.tolist(), s.tolist())) for q, i, s in maxscore.search_shard(ids[:20], vectors[:20], ids, vectors, k, seed_rows=32, step=5)}
    assert got == brute(dict(zip(ids[:20].tolist(), vectors[:20])), list(zip(ids.tolist(), vectors)), k)


@pytest.mark.parametrize("shard,block", [(16_384, 4096), (60, 3)])
def test_corpus(spark, shard, block):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    v = maxscore.quantised(rows)
    plain = [(r.vec_id, np.floor(64 * np.array(r.embedding, np.float64)).astype(int)) for r in rows.collect()]
    want = brute({i: x for i, x in plain if i % 20 == 0}, plain, 20)
    got = {}
    for r in maxscore.top_k(v, F.col("vec_id") % 20 == 0, shard_rows=shard, query_rows=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: [x[1:] for x in sorted(found)] for q, found in got.items()} == want
    assert all([x[0] for x in sorted(found)] == list(range(1, 21)) for found in got.values())


def test_edges(spark):
    schema = "vec_id bigint, embedding array<float>, q string, v string, rank int"
    good = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0]), (2, [-1.0]), (5, [])]
    bad = [(3, None), (4, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame([(*r, "q", "v", 0) for r in good + bad], schema)
    got = maxscore.top_k(maxscore.quantised(df), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 64 * 64 + 32 * 32), (5, 0), (2, -4096), (2, -4096)]
    assert maxscore.top_k(maxscore.quantised(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_are_exact(spark):
    """Components and scores beyond 64 bits, beside common ones, against Python's integers."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 8) * 10.0 ** rng.integers(-1, 30)).tolist()) for i in range(120)]
    rows += [(200 + i, [1e8] * 64) for i in range(3)] + [(220, [1.0] * 64), (221, [3e38] * 64), (240, [-3e38] * 64)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    plain = [(r.vec_id, [int(np.floor(64 * np.float64(x))) for x in r.embedding]) for r in df.collect()]
    want = brute({i: x for i, x in plain if i % 20 == 0}, plain, 7)
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    for shard, seed in ((10_000, 4096), (10, 40)):
        got = {}
        for r in maxscore.top_k(maxscore.quantised(df), F.col("vec_id") % 20 == 0, k=7, shard_rows=shard, seed_rows=seed).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert {q: [x[1:] for x in sorted(found)] for q, found in got.items()} == {q: [(i, clamp(s)) for i, s in found] for q, found in want.items()}
    double = spark.createDataFrame([(0, [1e308]), (1, [1.0])], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in maxscore.quantised(double).collect()] == [1]


def test_vectors_are_not_copied_to_query_blocks(spark):
    """Blocks of queries come to the shards: each vector is written once, whatever the number of blocks."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 6).tolist()) for i in range(400)], "vec_id bigint, embedding array<double>")
    plain = [(r.vec_id, [int(np.floor(64 * x)) for x in r.embedding]) for r in df.collect()]
    want = brute({i: x for i, x in plain if i % 5 == 0}, plain, 3)
    top = maxscore.top_k(maxscore.quantised(df), F.col("vec_id") % 5 == 0, k=3, shard_rows=90, query_rows=9, seed_rows=20)
    got = {}
    for r in top.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: [x[1:] for x in sorted(found)] for q, found in got.items()} == want
