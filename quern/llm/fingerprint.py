"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
SIZE = 256


def words(text: Column) -> Column:
    """Lower-cased words: runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Distinct 64-bit hashes of all shingles; fewer words than width make one shingle, none makes none.

    words should be a column of its own, so that it is not split again for every shingle.
    """
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    whole = F.transform(F.slice(F.array(F.array_join(words, " ")), 1, F.least(n, F.lit(1))), lambda w: F.xxhash64(w))
    return F.array_distinct(F.when(n >= width, each).otherwise(whole))


def sketch(hashes: Column, size: int = SIZE) -> Column:
    """The `size` smallest distinct hashes in order; all, if there are fewer."""
    return F.slice(F.sort_array(hashes), 1, size)


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of two parts together, from their sketches."""
    return sketch(F.array_distinct(F.concat(a, b)), size)


def merge_groups(sketches: DataFrame, keys: list[str], col: str = "sketch", size: int = SIZE, salts: int = 32) -> DataFrame:
    """The merged sketch of each group. Parts are thinned to one sketch a salt first, so a group that
    holds a third of all rows is spread; no step holds more than `size` hashes for each part."""
    hashes = sketches.select(*keys, F.explode(col).alias("_h"))
    part = hashes.groupBy(*keys, F.pmod("_h", F.lit(salts)).alias("_salt")).agg(F.collect_set("_h").alias("_all"))
    thin = part.select(*keys, sketch(F.col("_all"), size).alias("_s"))
    return thin.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("_s"))), 1, size).alias(col))


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of shingles in common, from 0 to 1: the share of the union's sketch that is in
    both. Exact while the union has at most `size` shingles. Two texts without words have 1."""
    union = merge(a, b, size)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below `size`. The k-th smallest of n hashes that are
    even over 2^64 lies near k / n of the range."""
    span = (F.element_at(a, size).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise(F.lit(size - 1.0) / span)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and counts; 1 if a has none."""
    r = resemblance(a, b, size)
    na, nb = distinct_shingles(a, size), distinct_shingles(b, size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r / (1 + r) * (na + nb) / na))


def to_text(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash, in order; a text without words has the empty one."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprint(docs: DataFrame, col: str, out: str, size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """docs with column `out`, the sketch of the whole text in col. Null counts as the empty text."""
    split = docs.withColumn("_words", words(F.coalesce(F.col(col), F.lit(""))))
    hashed = split.withColumn(out, sketch(shingle_hashes(F.col("_words"), width), size))
    return hashed.drop("_words")
