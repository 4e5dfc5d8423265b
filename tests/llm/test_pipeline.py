"""The pipeline's stages one by one against plain versions of their decisions."""

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import common, langid, quality, simhash, stages
from tests.llm.test_simhash import brute, plain_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = common.table(spark, SF, "documents").withColumn("score", F.lit("extra"))
    odd = spark.createDataFrame([(10**9, "12345 ... !!", "en", "s", 12, ""), (10**9 + 1, None, "en", "s", 0, ""), (10**9 + 2, "", "en", "s", 0, ""), (10**9 + 3, "# $ % ", "de", "s", 6, "")], docs.schema)
    docs = common.cut(docs.unionByName(odd), "docs")
    model = langid.train(docs, common.crc_of("doc_id") % 3 != 1)
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.drop("score"), model, ["doc_id"]).collect()}
    first = common.cut(stages.language_id(spark, docs, SF), "a")
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {d for d, (lang, s) in told.items() if lang != "und" and s >= 0.5}
    assert docs.count() - 4 - first.count() <= 2

    second = common.cut(stages.quality_classifier(spark, first, SF), "b")
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in second.collect()}
    known = [r.doc_id for r in first.collect() if r.doc_id in labels]
    assert np.mean([(d in kept) == (labels[d] == 1) for d in known]) > 0.97
    assert all(d in kept for d in known if labels[d] == 1) and second.columns == docs.columns

    third = common.cut(stages.simhash_near_dedup(spark, second, SF), "c")
    rows = sorted(second.select("doc_id", "text").collect())
    roots = brute([plain_fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in third.collect()) == sorted({rows[w].doc_id for w in roots}) and third.columns == docs.columns

    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    packed = stages.best_fit_packing(spark, third, SF).collect()
    want = sum(len(word.encode(r.text, add_special_tokens=False).ids) + 1 for r in third.collect())
    assert sum(r.length for r in packed) == want and {r.doc_id for r in packed} == {r.doc_id for r in third.collect()}
    assert len({r.sequence_id for r in packed}) <= want / 2048 * 1.05 + 2


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:4] == ["doc_id", "piece", "start", "length"] and out.count() > 100


def test_representatives_edges(spark):
    schema = "doc_id bigint, text string, fp string, n int, root int"
    rows = [(5, "same words in here"), (5, "same words in here"), (3, "Same words in HERE"), (None, "same words in here"), (9, None), (8, ""), (None, "lonely row without id"), (5, "another text with the same id")]
    docs = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], schema)
    got = sorted((r.doc_id or -1, r.text or "") for r in simhash.representatives(docs).collect())
    assert got == [(-1, "lonely row without id"), (3, "Same words in HERE"), (5, "another text with the same id"), (8, "")]
    assert sorted((r.doc_id or -1, r.text or "") for r in simhash.representatives(docs, broadcast_rows=0).collect()) == got
    twice = docs.where("doc_id = 5 AND text LIKE 'same%'")
    assert twice.count() == 2 and simhash.representatives(twice).count() == 1
    assert simhash.representatives(docs.limit(0)).columns == docs.columns


def test_stages_take_an_empty_table(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_stages_with_clashing_names(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    names = ["_id", "_HASH", "_null", "_quality", "_lang_pred", "_lang_score", "_whole_text", "_stats", "fp", "n", "root", "stays"]
    plain = common.cut(docs, "plain")
    odd = common.cut(docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)]), "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, odd = common.cut(stage(spark, plain, SF), name), common.cut(stage(spark, odd, SF), name)
        assert odd.columns == [*docs.columns, *names] and plain.count() > 0
        assert odd.select(docs.columns).exceptAll(plain).count() == 0 and plain.exceptAll(odd.select(docs.columns)).count() == 0
        assert odd.select(*[F.max(c) for c in names]).first() == tuple(range(len(names)))
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == corpus_pipeline.STAGES[-1][1](spark, plain, SF).count()
