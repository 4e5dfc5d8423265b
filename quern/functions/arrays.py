"""Array and map (hstore) functions with the reference's NULL and position rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(a: Column) -> Column:
    """array_length(a, 1): null for an empty array."""
    return F.when(F.size(a) > 0, F.size(a))


def dims(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.lit("[1:"), F.size(a).cast("string"), F.lit("]")))


def position(a: Column, x: Column) -> Column:
    """Null where the value is absent."""
    return F.nullif(F.array_position(a, x), F.lit(0).cast("bigint"))


def positions(a: Column, x: Column) -> Column:
    return F.filter(F.transform(a, lambda e, i: F.when(e.eqNullSafe(x), i + 1)), lambda p: p.isNotNull())


def contains(a: Column, b: Column) -> Column:
    """a @> b: every element of b occurs in a; a null never does."""
    return F.forall(b, lambda x: F.coalesce(F.array_contains(a, x), F.lit(False)))


def overlap(a: Column, b: Column) -> Column:
    """a && b"""
    return F.exists(a, lambda x: F.coalesce(F.array_contains(b, x), F.lit(False)))


def to_string(a: Column, delimiter: str, null: str | None = None) -> Column:
    return F.array_join(a.cast("array<string>"), delimiter) if null is None else F.array_join(a.cast("array<string>"), delimiter, null)


def assign(a: Column, i: int, x: Column) -> Column:
    """a[i] := x; nulls fill a gap beyond the end."""
    longer = F.concat(a, F.array_repeat(F.lit(None), F.greatest(F.lit(i) - F.size(a), F.lit(0))))
    return F.transform(longer, lambda e, k: F.when(k == i - 1, x).otherwise(e))


def uniq(a: Column) -> Column:
    """Without an element that equals the one before it."""
    return F.transform(F.filter(F.transform(a, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda r: (r["i"] == 0) | ~r["e"].eqNullSafe(F.get(a, r["i"] - 1))), lambda r: r["e"])


def hstore_get(h: Column, key: Column) -> Column:
    return F.try_element_at(h, key)


def hstore_has(h: Column, key: str) -> Column:
    return F.map_contains_key(h, key)


def hstore_concat(a: Column, b: Column) -> Column:
    """a || b: b's values win."""
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.map_concat(kept, b)


def hstore_contains(a: Column, b: Column) -> Column:
    """a @> b"""
    return F.forall(F.map_entries(b), lambda e: F.map_contains_key(a, e["key"]) & F.try_element_at(a, e["key"]).eqNullSafe(e["value"]))


def hstore_delete(a: Column, *keys: str) -> Column:
    return F.map_filter(a, lambda k, _: ~k.isin(*keys))


def ltree_is_descendant(path: Column, ancestor: Column) -> Column:
    """path <@ ancestor, of label paths with dots."""
    return (path == ancestor) | F.startswith(path, F.concat(ancestor, F.lit(".")))


def ltree_level(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def idx(a: Column, x: Column) -> Column:
    """idx(): the first place of x from 1, 0 where it is not there."""
    return F.coalesce(F.array_position(a, x), F.lit(0)).cast("int")


def subarray(a: Column, start: int, count: int | None = None) -> Column:
    """subarray(a, start, count): start from the end if negative; a negative count leaves off that many at the end."""
    n = F.size(a)
    first = F.lit(start - 1) if start > 0 else F.greatest(n + start, F.lit(0)) if start < 0 else F.lit(0)
    many = n if count is None else F.lit(count) if count >= 0 else F.greatest(n + count - first, F.lit(0))
    return F.slice(a, first + 1, many)


def minus(a: Column, b: Column) -> Column:
    """a - b: a's elements that b lacks, each once, ascending."""
    return F.array_sort(F.array_except(a, b))
