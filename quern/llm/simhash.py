"""SimHash fingerprints, their links within a few bits by vantage-point trees, and link components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common

SEED = 42
_HASH_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit b is 1 if more than half of the shingle hashes have it set; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words))
    ends = (ends + 1).cumsum() - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    total = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _HASH_BLOCK):
        n = min(_HASH_BLOCK, total - at)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + n].tolist(), ends[at + width - 1 : at + width - 1 + n].tolist())), np.uint64, n)
        ones += _bit_sums(hashes)
    bits = np.flatnonzero(2 * ones > total)
    return int(sum(1 << int(b) for b in bits))


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def with_fingerprints(docs: DataFrame, keep: list[str], width: int = 3) -> DataFrame:
    """The columns in keep and fp, the fingerprint as a signed 64-bit number, of every whole text. Columns
    in keep may have any names but fp."""
    mine = common.free_names(docs.select(*keep), "_whole_text")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(0)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], names=[*batch.schema.names[1:], "fp"])

    return docs.select(F.col("text").cast("string").alias(mine), *keep).mapInArrow(run, docs.select(*keep).schema.add("fp", "long"))


# --- vantage-point trees -------------------------------------------------------------------


class Node:
    """An inner node: fingerprints within `radius` of `point` are inside, the others outside."""

    __slots__ = ("point", "radius", "inside", "outside")

    def __init__(self, point: int, radius: int, inside, outside):
        self.point, self.radius, self.inside, self.outside = point, radius, inside, outside


def build(sample: np.ndarray, depth: int, seed: int = 7, reach: int = 2) -> tuple[object, int]:
    """A vantage-point tree of at most `depth` levels over a sample; leaves are shard numbers.

    At each node several points of the sample are tried, each with the radii around its median distance,
    and the pair is taken that has the fewest sampled rows in the band where a partner can lie on the other
    side, for the evenness of the split: those rows are the visitors that a shard has to hold.
    """
    rng = np.random.default_rng(seed)
    count = 0

    def choose(points: np.ndarray) -> tuple[np.uint64, int] | None:
        best, least = None, np.inf
        tried = points if len(points) <= 4096 else points[rng.integers(len(points), size=4096)]
        for point in points[rng.integers(len(points), size=12)]:
            at = np.bincount(np.bitwise_count(tried ^ point), minlength=65)
            below = at.cumsum()
            for radius in range(64):
                share = below[radius] / len(tried)
                if not 0.25 <= share <= 0.75:
                    continue
                band = at[max(0, radius - reach + 1) : radius + reach + 1].sum() / len(tried)
                cost = (band + 0.02) / (share * (1 - share))
                if cost < least:
                    best, least = (point, radius), cost
        return best

    def grow(points: np.ndarray, left: int):
        nonlocal count
        if left and len(points) >= 8:
            point, radius = choose(points) or (points[rng.integers(len(points))], None)
            d = np.bitwise_count(points ^ point)
            if radius is None:  # no even split for any point tried
                radius = int(np.median(d))
            near = d <= radius
            if near.all():  # ties at the median: split below it
                radius, near = radius - 1, d <= radius - 1
            if near.any() and not near.all():
                return Node(int(point), radius, grow(points[near], left - 1), grow(points[~near], left - 1))
        count += 1
        return count - 1

    return grow(sample, depth), count


def route(tree, fps: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf: its number, the rows at home there, and the visitors from other leaves. A leaf with
    visitors alone is yielded too: rows at home there can lie in other batches.

    Two fingerprints within `reach` of each other meet in the home leaf of at least one of them:
    at a node, a row d from the point can only have a partner whose distance is within d +- reach
    (the triangle bound). Rows at home inside visit the outside when the bound reaches it; visitors
    go to either side that the bound reaches.
    """

    def walk(node, home: np.ndarray, guest: np.ndarray):
        if not isinstance(node, Node):
            if home.size or guest.size:
                yield node, home, guest
            return
        point = np.uint64(node.point)
        dh = np.bitwise_count(fps[home] ^ point).astype(np.int16)
        dg = np.bitwise_count(fps[guest] ^ point).astype(np.int16)
        yield from walk(node.inside, home[dh <= node.radius], guest[dg - reach <= node.radius])
        crossing = home[(dh <= node.radius) & (dh + reach > node.radius)]
        yield from walk(node.outside, home[dh > node.radius], np.concatenate([guest[dg + reach > node.radius], crossing]))

    yield from walk(tree, np.arange(len(fps)), np.zeros(0, np.int64))


def links(home: np.ndarray, guest: np.ndarray, reach: int, leaf: int = 192) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smaller component member, member) that join all fingerprints of `home` and `guest` that
    are linked by a pair with one side in `home`: as many pairs as linked fingerprints, not as links."""
    points = np.concatenate([home, guest])
    parent = np.arange(len(points))

    def roots(rows: np.ndarray) -> np.ndarray:
        found = parent[rows]
        while (parent[found] != found).any():
            found = parent[found]
        parent[rows] = found
        return found

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            ra, rb = roots(a), roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))

    rng = np.random.default_rng(len(points))
    todo = [(np.arange(len(home)), np.arange(len(home), len(points)), 0)]
    while todo:
        own, other, stuck = todo.pop()
        if own.size <= leaf or stuck >= 4:
            for a, b in _close(points, own, other, reach):
                unite(a, b)
            continue
        point = points[own[rng.integers(own.size)]]
        dh = np.bitwise_count(points[own] ^ point).astype(np.int16)
        dg = np.bitwise_count(points[other] ^ point).astype(np.int16)
        radius = int(np.median(dh))
        if (dh <= radius).all():
            radius -= 1
        inside = dh <= radius
        if not inside.any():
            todo.append((own, other, stuck + 1))
            continue
        crossing = own[inside & (dh + reach > radius)]
        # A split that leaves nearly all rows on one side, again and again, is a dense ball: it is compared block by block.
        again = stuck + 1 if max(inside.sum(), (~inside).sum()) > 0.9 * own.size else 0
        todo.append((own[inside], other[dg - reach <= radius], again))
        todo.append((own[~inside], np.concatenate([other[dg + reach > radius], crossing]), again))
    top = roots(np.arange(len(points)))
    moved = np.flatnonzero(top != np.arange(len(points)))
    return points[top[moved]], points[moved]


def _close(points: np.ndarray, own: np.ndarray, other: np.ndarray, reach: int, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs with one side in `own`, in blocks of at most about `block` comparisons."""
    everyone = np.concatenate([own, other])
    step = max(1, min(own.size, 4096, block // max(1, min(everyone.size, block))))
    for at in range(0, own.size, step):
        rows = own[at : at + step]
        for left in range(at, everyone.size, max(1, block // step)):
            cols = everyone[left : left + max(1, block // step)]
            a, b = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[cols][None, :]) <= reach)
            yield rows[a], cols[b]


def link_edges(fps: DataFrame, reach: int = 2, rows_per_shard: int = 20_000, rows_per_leaf: int = 32, sample_rows: int = 4_000_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints in column fp whose components are those of all
    links within `reach` bits. Every fingerprint is indexed and searched.

    The tree over the shards is built on a sample, chosen by a hash: rows_per_leaf fingerprints for each
    shard, 50,000 at least and about sample_rows (32 MB) at most. Up to some 2 * 10^9 distinct
    fingerprints a shard has about rows_per_shard at home; beyond, shards grow with the rows (10^12
    would give 8 million in each, 64 MB), and each shard has a tree of its own inside links() in any case.
    """
    spark = fps.sparkSession
    n = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / rows_per_shard))))
    wanted = min(sample_rows, max(50_000, rows_per_leaf << depth))
    sample = fps.select("fp").where(common.share_below(wanted / max(1, n), F.col("fp"))).toArrow()["fp"].to_numpy().view(np.uint64)
    tree, _ = build(np.sort(sample), depth, reach=reach)
    sent = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for shard, home, guest in route(sent.value, own, reach):
                rows = np.concatenate([own[home], own[guest]]).view(np.int64)
                at_home = np.arange(len(rows)) < len(home)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int64)), pa.array(rows), pa.array(at_home)], names=["shard", "fp", "home"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        points, home = group["fp"].to_numpy(np.int64).view(np.uint64), group["home"].to_numpy(bool)
        if not home.any():  # visitors alone meet in their home leaves
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        a, b = links(np.sort(points[home]), np.sort(points[~home]), reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.select("fp").mapInArrow(deal, "shard bigint, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInPandas(join, "a bigint, b bigint")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node (as a signed number) that each node of the edges reaches.

    Small-star and large-star rounds, each cut to a table in the shared folder; a round keeps at
    most as many edges as there were, and about log(n) rounds suffice.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(low, "a").where("b <> m").select(F.col("m").alias("a"), "b")
        return moved.unionAll(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    def summary(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    now = common.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = summary(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = common.cut(small(large(now)), "edges")
        after = summary(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _class_roots(marked: DataFrame, reach: int) -> DataFrame:
    """fp and root of every distinct fingerprint: the smallest fingerprint of its component."""
    classes = common.cut(marked.select("fp").distinct(), "classes")
    member = components(link_edges(classes, reach))
    return classes.join(member, classes.fp == member.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, reach: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id among all rows reachable over
    links between fingerprints that differ in at most `reach` bits, itself included.

    Texts are read once and never shuffled. Equal fingerprints are one point of the search, so a
    group of copies of any size costs one. A null or empty text has fingerprint 0 and links like
    any other. A null doc_id is never the smallest, unless a component has no other: then it is
    null. Repeated rows each keep their row. An empty table gives no rows.
    """
    marked = common.cut(with_fingerprints(docs, ["doc_id"], width), "fingerprints")
    rooted = common.cut(_class_roots(marked, reach), "roots")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    smallest = rooted.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(of_class, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, reach: int = 2, width: int = 3, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of docs with one of each near-duplicate component: that with the smallest doc_id (null
    last), of repeated doc_ids that whose text has the smallest hash, and of repeated rows any one.

    Null and empty texts have fingerprint 0 and are near duplicates of each other; long texts are taken
    whole; an empty table gives no rows; other columns may have any names. Only ids and hashes are grouped; the rows that go are then taken out by an anti join. Where at most
    broadcast_rows keys go, they are broadcast and texts stay where they are.
    """
    key = common.free_names(docs, "_null", "_id", "_hash")
    keyed = docs.withColumns(dict(zip(key, (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id"), F.lit(0)), F.xxhash64("text")))))
    # From here to `gone` and `again` rows have the key's columns and those added here, none of docs.
    marked = common.cut(with_fingerprints(keyed, key, width), "fingerprints")
    rooted = _class_roots(marked, reach)
    rows = marked.groupBy(*key, "fp").agg(F.count("*").alias("n"))
    placed = common.cut(rows.join(rooted, "fp").select(*key, "n", "root"), "placed")
    leaders = placed.groupBy("root").agg(F.min(F.struct(*key)).alias("first")).select("root", "first.*")
    stays = placed.join(leaders.withColumn("stays", F.lit(True)), ["root", *key], "left")
    gone = stays.where("stays IS NULL OR n > 1")
    gone = common.cut(gone.select(*key), "gone")
    # Counted keys of 17 bytes are broadcast up to 4 MB or so; more are met by shuffling, without a sort of the texts.
    few = gone.count() <= broadcast_rows
    kept = keyed.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), key, "left_anti")
    again = common.cut(stays.where("stays AND n > 1").select(*key), "repeated")
    if not again.isEmpty():
        kept = kept.unionByName(keyed.join(again, key, "left_semi").dropDuplicates(key))
    return kept.drop(*key)
