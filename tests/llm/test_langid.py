"""Language ID: n-grams against a plain loop, held-out accuracy, edges."""

import numpy as np
from pyspark.sql import functions as F

from quern.llm import common, langid

SCHEMA = "doc_id bigint, text string, lang string, score string, lang_pred int"


def test_counts_do_not_depend_on_cuts(monkeypatch):
    texts = ["Hello world, the end", "", "x", "ÀÉ 日本 text " * 30]
    whole = langid.counts(texts)
    assert whole.sum() == sum(3 * (len(t) + 2) - 3 for t in texts)
    model = langid.Model(["a", "b"], np.zeros(2), np.random.default_rng(0).random((langid.BUCKETS + 1, 2)).astype(np.float32))
    model.log_prob[-1] = 0
    ll = langid.log_likelihood(texts, model)
    monkeypatch.setattr(langid, "SEGMENT", 7)
    assert (langid.counts(texts) == whole).all()
    assert np.allclose(langid.log_likelihood(texts, model), ll, rtol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", common.crc_of("doc_id") % 3 == 1)
    model = langid.train(docs, ~F.col("held_out"))
    got = langid.predict(docs, model, ["doc_id", "held_out", "lang"])
    assert got.count() == docs.count()
    right = got.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", "", 0), (2, "le chat et le chien", "fr", None, None), (3, None, "en", "", 0), (4, "123 !!", "en", "", 0), (5, "the the", None, "", 0), (None, "le le", "fr", "", 0), (1, "the cat and the dog", "en", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs, F.lit(True))
    got = langid.predict(docs, model, ["doc_id"]).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id or 0)] == ["fr", "en", "en", "fr", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    nothing = langid.train(empty, F.lit(True))
    assert nothing.langs == ["und"] and langid.predict(empty, nothing, ["doc_id"]).count() == 0
    one = langid.train(docs, F.lit(True), max_docs_per_lang=1)
    assert one.langs == ["en", "fr"]


def test_against_a_plain_loop(spark):
    """Naive Bayes from the definition: a loop over every n-gram of every text, with Python numbers."""
    from math import exp, log

    rows = [(i, t, x, "", 0) for i, (t, x) in enumerate([("the cat sat", "en"), ("The dog, the end", "en"), ("le chat noir", "fr"), ("un chien", "fr"), ("der hund", "de"), ("the", "en")])]
    docs = spark.createDataFrame(rows, SCHEMA)

    def bucket(gram):
        h = 0x9E3779B1 * len(gram) & 0xFFFFFFFF
        for c in gram:
            h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
            h ^= h >> 15
        return (h * 0x85EBCA6B & 0xFFFFFFFF) >> 17

    def buckets(text):
        text = f" {text.lower()} "
        return [bucket(text[i : i + n]) for n in (1, 2, 3) for i in range(len(text) - n + 1)]

    seen, sizes = {}, {}
    for _, t, x, _, _ in rows:
        sizes[x] = sizes.get(x, 0) + 1
        for b in buckets(t):
            seen.setdefault(x, {})[b] = seen.setdefault(x, {}).get(b, 0) + 1

    def plain(text):
        total = {}
        for x in sizes:
            every = sum(seen[x].values()) + 0.1 * langid.BUCKETS
            total[x] = log(sizes[x] / len(rows)) + sum(log((seen[x].get(b, 0) + 0.1) / every) for b in buckets(text))
        best = max(sorted(total), key=total.get)
        return best, 1 / sum(exp(v - total[best]) for v in total.values())

    asked = ["the chat", "CHIEN noir", "hund und cat", "x", "é", "le the der", "dog " * 50]
    df = spark.createDataFrame([(i, t, None, "", 0) for i, t in enumerate(asked)], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, langid.train(docs, F.lit(True)), ["doc_id"]).collect()}
    for i, t in enumerate(asked):
        lang, score = plain(t)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4


def test_letters_and_many_languages(spark):
    rows = [(1, "½ ² ①", "en", "", 0), (2, "Ⅷ ٣ 〇", "en", "", 0), (3, "ª", "en", "", 0), (4, "the cat", "en", "", 0), (5, "le chat", "fr", "", 0), (6, "the dog", "en", "", 0), (7, "zz", "zz", "", 0), (8, "le", "fr", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs, F.col("doc_id") > 3, max_langs=2)
    assert model.langs == ["en", "fr"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model, ["doc_id"]).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und" and got[4] == "en"
    clash = docs.withColumnRenamed("score", "_whole_text")
    assert langid.predict(clash, model, ["doc_id", "_whole_text"]).columns == ["doc_id", "_whole_text", "lang_pred", "score"]
