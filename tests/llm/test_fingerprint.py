"""Bottom-k sketches against exact shingle sets; the edited texts against a plain loop."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quern.llm import fingerprint as fp
from quern.llm.queries_dedup import edited_pairs, op2_fingerprints


def shingles(text):
    w = (text or "").lower().replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((doc, text, text[: len(text) - half] + nxt[:half], nxt))
    return out


def test_corpus(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in op2_fingerprints(spark, sf).collect()}
    assert len(got) == len(rows)
    far = 0
    by_text = {}
    for doc, text, edited, nxt in plain(rows):
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        far += abs(r.near_edited - jaccard(text, edited)) > 0.1
        assert abs(r.near_edited - jaccard(text, edited)) < 0.16 and abs(r.near_next - jaccard(text, nxt)) < 0.16
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert far <= len(rows) // 50


@pytest.mark.parametrize("per", [1, 3, 1000])
def test_edges(spark, per, monkeypatch):
    from quern.llm import neighbours

    monkeypatch.setattr(neighbours.with_next, "__defaults__", (per,))
    rows = [(1, None), (5, "five words are in here"), (5, "one"), (90, "a b c d e f g h"), (91, ""), (None, "no id at all here ok"), (1000, "x " * 20_000), (7, "é😀" * 9), (5, "one")]
    docs = spark.createDataFrame([(*r, "s", 1, True) for r in rows], "doc_id bigint, text string, sketch string, _range int, _ghost boolean")
    got = edited_pairs(docs).collect()
    want = plain(rows)
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == sorted((d or 0, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in want)
    alone = edited_pairs(docs.where("doc_id = 90")).collect()
    assert len(alone) == 1 and alone[0].sketch == alone[0].next_sketch
    assert edited_pairs(docs.limit(0)).count() == 0


def test_estimates(spark):
    a, b = " ".join(f"w{i}" for i in range(6000)), " ".join(f"w{i}" for i in range(3000, 9000))
    df = spark.createDataFrame([(a, b, "w1 w2")], "a string, b string, c string")
    s = fp.fingerprint(fp.fingerprint(fp.fingerprint(df, "a", "sa"), "b", "sb"), "c", "sc")
    A, B, C = F.col("sa"), F.col("sb"), F.col("sc")
    r = s.select(fp.resemblance(A, B), fp.containment(A, B), fp.distinct_shingles(A), fp.distinct_shingles(C), fp.distinct_shingles(fp.merge(A, B)), fp.resemblance(A, A), fp.containment(C, A)).first()
    assert abs(r[0] - 1 / 3) < 0.12 and abs(r[1] - 0.5) < 0.15 and abs(r[2] / 5996 - 1) < 0.25 and r[3] == 1 and abs(r[4] / 8996 - 1) < 0.25 and r[5] == 1 and r[6] < 0.05


def test_merged_groups_equal_the_sketch_of_the_whole(spark):
    hashes = spark.range(5000).select(F.pmod("id", F.lit(2)).alias("g"), F.pmod("id", F.lit(50)).alias("part"), F.xxhash64("id").alias("h"))
    parts = hashes.groupBy("g", "part").agg(fp.sketch(F.collect_set("h")).alias("sketch"))
    want = {r.g: r.s for r in hashes.groupBy("g").agg(fp.sketch(F.collect_set("h")).alias("s")).collect()}
    assert {r.g: r.sketch for r in fp.merge_groups(parts, ["g"]).collect()} == want


def test_uneven_and_repeated_ids_are_split(spark, monkeypatch):
    from quern.llm import neighbours

    def most(docs):
        rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
        paired, _ = neighbours.with_next(rows, "doc_id", "text", {"_next": "text"}, 100)
        return max(r["count"] for r in paired.groupBy("_range").count().collect())

    uneven = spark.range(4000).select(F.when(F.col("id") == 0, 10**15).otherwise(F.col("id")).alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    hot = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    assert most(uneven) < 400 and most(hot) < 400
    for docs in (uneven, hot):
        want = plain([(r.doc_id, r.text) for r in docs.collect()])
        monkeypatch.setattr(neighbours.with_next, "__defaults__", (100,))
        got = edited_pairs(docs).select("doc_id", "edited_sha256").collect()
        assert sorted((r.doc_id or -1, r.edited_sha256) for r in got) == sorted((d or -1, hashlib.sha256(e.encode()).hexdigest()) for d, _, e, _ in want)
