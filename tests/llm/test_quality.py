"""Quality scores: held-out accuracy, calibration against brute force, edges."""

import numpy as np
from pyspark.sql import functions as F

from quern.llm import common, quality


def test_pool_adjacent_is_monotone_and_optimal():
    rng = np.random.default_rng(0)
    w, t = rng.integers(1, 5, 40).astype(float), None
    t = w * np.clip(np.linspace(0, 1, 40) + rng.normal(0, 0.3, 40), 0, 1)
    fitted = quality.pool_adjacent(w, t)
    assert (np.diff(fitted) >= -1e-12).all() and abs((w * fitted).sum() - t.sum()) < 1e-9
    # max-min formula of isotonic regression
    want = [max(min(t[i : k + 1].sum() / w[i : k + 1].sum() for k in range(j, 40)) for i in range(j + 1)) for j in range(40)]
    assert np.allclose(fitted, want)


def test_statistics_are_finite():
    for text in ["", " ", "\n\n", "a", "İİ", "x" * 100_000, "!!! ### 123", "日本 語"]:
        found = quality.statistics(text)
        assert len(found) == len(quality.STATISTICS) and np.isfinite(found).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    held_out = common.crc_of("doc_id") % 5 == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    stats = common.cut(quality.with_statistics(docs, ["doc_id"]), "statistics")
    model = quality.train(stats, quality.sample_labels(labels, ~held_out))
    rows = quality.score(stats, model, ["doc_id"]).join(labels, "doc_id").where(held_out).select("quality", "score").toPandas()
    assert ((rows.score >= 0.3) == (rows.quality == 1)).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_edges(spark):
    schema = "doc_id bigint, text string, score string, stats int, quality string"
    rows = [(1, None, "a", 1, ""), (2, "", "b", 2, None), (3, "word " * 30_000, None, None, ""), (None, "no id", "", 0, ""), (2, "", "b", 2, None)]
    docs = spark.createDataFrame(rows, schema)
    stats = quality.with_statistics(docs, ["doc_id"])
    assert stats.count() == 5
    labels = spark.createDataFrame([(1, 0, 5), (2, 1, 5), (3, 1, 5), (3, None, 5), (None, 1, 5), (9, 7, 5)], "doc_id bigint, quality int, toxic int")
    for marked in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality.train(stats, quality.sample_labels(marked, F.lit(True)))
        got = quality.score(stats, model, ["doc_id"]).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(stats.limit(0), model, ["doc_id"]).count() == 0


def test_fit_against_a_plain_loop(spark):
    """Standardised statistics, cosine features, ridge weights by a loop over all rows, folds left out in turn,
    and the calibration by the max-min formula."""
    rng = np.random.default_rng(4)
    d = len(quality.STATISTICS)
    n = 120
    x = rng.normal(0, 1, (n, d)) * np.linspace(0.5, 3, d)
    y = (x[:, 0] + 0.5 * x[:, 3] + rng.normal(0, 0.5, n) > 0).astype(int)
    stats = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "doc_id bigint, stats array<double>").repartition(5)
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(n)], "doc_id bigint, quality int")
    model = quality.train(stats, quality.sample_labels(labels, F.lit(True)), size=12, ridge=1e-2)

    mean, scale = x.mean(axis=0), x.std(axis=0)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)

    def feature(row):
        out = []
        for k in range(12):
            dot = sum(max(-6, min(6, (row[j] - mean[j]) / scale[j])) * model.directions[j, k] for j in range(d))
            out.append(np.cos(dot + model.phases[k]) * (2 / 12) ** 0.5)
        return [*out, 1.0]

    z = np.array([feature(r) for r in x])

    def ridge(rows):
        a, b = np.zeros((13, 13)), np.zeros(13)
        for i in rows:
            a += np.outer(z[i], z[i])
            b += z[i] * y[i]
        return np.linalg.solve(a + np.diag([1e-2 * len(rows) + 1e-9] * 12 + [1e-9]), b)

    assert np.allclose(model.weights, ridge(range(n)), atol=1e-8)
    fold = {r.doc_id: r.f for r in stats.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)).alias("f")).collect()}
    weights = {f: ridge([i for i in range(n) if fold[i] != f]) for f in set(fold.values())}
    raw = [np.rint((np.clip(z[i] @ weights[fold[i]], -1, 2) + 1) * 1000) for i in range(n)]
    steps = sorted(set(raw))
    w = np.array([sum(r == s for r in raw) for s in steps], float)
    t = np.array([sum(y[i] for i in range(n) if raw[i] == s) for s in steps], float)
    m = len(steps)
    means = [[t[i : k + 1].sum() / w[i : k + 1].sum() if k >= i else 0 for k in range(m)] for i in range(m)]
    want = [max(min(means[i][j:]) for i in range(j + 1)) for j in range(m)]
    assert np.allclose(model.raw, np.array(steps) / 1000 - 1) and np.allclose(model.probability, want)
    got = {r.doc_id: r.score for r in quality.score(stats, model, ["doc_id"]).collect()}
    assert all(abs(got[i] - np.clip(np.interp(z[i] @ model.weights, model.raw, want), 0, 1)) < 1e-9 for i in range(n))


def test_clashing_names_and_repeated_labels(spark):
    docs = spark.createDataFrame([(1, "one text", "a", 2), (2, "Two!", "b", 3)], "doc_id bigint, text string, _whole_text string, _stats int")
    stats = quality.with_statistics(docs, ["doc_id", "_whole_text", "_stats"])
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (2, 0)], "doc_id bigint, quality int")
    model = quality.train(stats, quality.sample_labels(labels, F.lit(True)))
    got = quality.score(stats, model, ["doc_id", "_whole_text", "_stats"]).collect()
    assert len(got) == 2 and got[0].asDict().keys() == {"doc_id", "_whole_text", "_stats", "score"}
