"""SimHash links against brute force over all pairs."""

import numpy as np
import xxhash

from quern.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)
    out = [base]
    for _ in range(2):
        flips = np.uint64(1) << rng.integers(0, 63, len(base)).astype(np.uint64)
        out.append(out[-1] ^ flips ^ (np.uint64(1) << rng.integers(0, 63, len(base)).astype(np.uint64)))
    return np.unique(np.concatenate(out))


def test_fingerprint():
    for t in [None, "", " \t\n", "One", "a b", "A b C", "a b c d", "É é x\x0by\x0cz\xa0w  q", "the cat sat on the mat " * 50]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_tree_sends_every_close_pair_to_one_shard():
    fps = clustered(900, 3)
    tree, shards = simhash.build(fps[::4], 4)
    met = set()
    for _, home, guest in simhash.route(tree, fps, 2):
        every = np.concatenate([home, guest])
        close = np.bitwise_count(fps[home][:, None] ^ fps[every][None, :]) <= 2
        met |= {(min(home[a], every[b]), max(home[a], every[b])) for a, b in zip(*np.nonzero(close)) if home[a] != every[b]}
    close = np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1)
    assert shards > 4 and met == set(zip(*np.nonzero(close)))


def test_local_links_match_brute_force():
    fps = clustered(1500, 5)
    a, b = simhash.links(fps, np.zeros(0, np.uint64), 2, leaf=16)
    at = {int(f): i for i, f in enumerate(fps)}
    want = brute([int(f) for f in fps])
    got = list(range(len(fps)))
    for x, y in zip(a, b):
        got[at[int(y)]] = at[int(x)]
    assert got == want


def test_dense_ball():
    bits = [sum(1 << i for i in range(12) if k >> i & 1) for k in range(4096)]
    a, b = simhash.links(np.array(bits, np.uint64), np.zeros(0, np.uint64), 2, leaf=16)
    assert len(b) == 4095 and set(a.tolist()) == {0}


def test_link_edges_over_shards(spark):
    fps = clustered(3000, 11)
    df = spark.createDataFrame([(int(np.int64(f)),) for f in fps.view(np.int64)], "fp bigint")
    got = {r.node: r.root for r in simhash.components(simhash.link_edges(df, rows_per_shard=200, sample_rows=500)).collect()}
    want = brute([int(f) for f in fps])
    groups = {}
    for f, w in zip(fps.view(np.int64).tolist(), want):
        groups.setdefault(w, set()).add(f)
    for members in groups.values():
        if len(members) > 1:
            assert {got.get(m, m) for m in members} == {min(members)}
        else:
            assert not members & got.keys()


def test_visitors_meet_rows_of_other_batches(spark):
    fps = clustered(1200, 13)
    tree, shards = simhash.build(fps[::2], 6)
    want = brute([int(f) for f in fps])
    at = {int(f): i for i, f in enumerate(fps)}
    for rows in (1, 2, 3):
        leaves = {}
        for start in range(0, len(fps), rows):
            batch = fps[start : start + rows]
            for leaf, home, guest in simhash.route(tree, batch, 2):
                own, others = leaves.setdefault(leaf, ([], []))
                own.append(batch[home])
                others.append(batch[guest])
        met = set()
        for own, others in leaves.values():
            own = np.concatenate(own)
            every = np.concatenate([own, *others])
            a, b = np.nonzero(np.bitwise_count(own[:, None] ^ every[None, :]) <= 2)
            met |= {(min(at[int(x)], at[int(y)]), max(at[int(x)], at[int(y)])) for x, y in zip(own[a], every[b]) if x != y}
        assert shards > 16 and met == set(zip(*np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))))

    df = spark.createDataFrame([(f,) for f in fps.view(np.int64).tolist()], "fp bigint")
    batch_rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r.node: r.root for r in simhash.components(simhash.link_edges(df, rows_per_shard=20)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    groups = {}
    for f, w in zip(fps.view(np.int64).tolist(), want):
        groups.setdefault(w, set()).add(f)
    assert all({got.get(m, m) for m in members} == {min(members)} for members in groups.values())
    empty = np.zeros(0, np.uint64)
    assert [x.size for x in simhash.links(empty, fps, 2)] == [0, 0]


def test_near_duplicates_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {rows[i].doc_id: rows[w].doc_id for i, w in enumerate(brute(fps))}
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == {r.doc_id: f for r, f in zip(rows, fps)}


def test_edges_of_input(spark):
    schema = "doc_id bigint, text string, fp string, component_id int, least int"
    rows = [(5, None, "x", 1, 2), (3, "", "", 0, 0), (7, " ", "", 0, 0), (9, "Same Words here now", "", 0, 0), (9, "same words HERE now", "", 0, 0), (None, "same words here now", "", 0, 0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    by = {}
    for r in got:
        by.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(by[3]) == [3, 5, 7] and sorted(by[9], key=str) == [9, 9, None]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
