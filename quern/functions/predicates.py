"""Predicates with the reference's NULL rules that Spark spells otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    """x BETWEEN SYMMETRIC a AND b; null if a bound is null, unlike least() and greatest()."""
    return ((x >= a) & (x <= b)) | ((x >= b) & (x <= a))


def eq_any(x: Column, array: Column) -> Column:
    """x = ANY (array): false for an empty array even if x is null; unknown if x is null, or if only a null could match."""
    return F.when(F.size(array) == 0, F.lit(False)).otherwise(F.exists(array, lambda e: e == x))


def all_of(array: Column, test) -> Column:
    """x op ALL (array): true for an empty array; false as soon as one is false; else unknown if one is."""
    return F.forall(array, test)


def similar_to(x: Column, pattern: str, escape: str = "\\") -> Column:
    """x SIMILAR TO pattern: SQL wildcards within regular expression syntax, over the whole string."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i] if not pattern[i].isalnum() else pattern[i])
        elif inside:
            inside = c != "]"
            out.append(c)
        elif c == "[":
            inside = True
            out.append(c)
        else:
            out.append({"%": ".*", "_": ".", ".": "\\.", "^": "\\^", "$": "\\$", "(": "(?:"}.get(c, c))
        i += 1
    return x.rlike(f"(?s)^(?:{''.join(out)})$")


def matches(x: Column, pattern: str, insensitive: bool = False) -> Column:
    """x ~ pattern, or x ~* pattern."""
    return x.rlike(("(?i)" if insensitive else "") + pattern)


def row_less(left: Sequence[Column], right: Sequence[Column], or_equal: bool = False) -> Column:
    """(a, b, ...) < (c, d, ...): decided by the first pair that differs; unknown if a null comes first."""
    out = F.lit(or_equal)
    for a, b in reversed(list(zip(left, right))):
        out = F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(a == b, out).otherwise(a < b)
    return out


def row_is_null(fields: Sequence[Column]) -> Column:
    """ROW(...) IS NULL: every field is null."""
    return F.forall(F.array(*[f.isNull() for f in fields]), lambda x: x)


def subscript(array: Column, i: Column) -> Column:
    """array[i], counted from 1; null where there is none."""
    return F.when(i > 0, F.get(array, i - 1))


def array_slice(array: Column, low: int, high: int) -> Column:
    """array[low:high], both ends included; empty where they do not meet the array."""
    low = max(low, 1)
    return F.slice(array, low, max(high - low + 1, 0))


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(a, b) OVERLAPS (c, d): half-open periods with ends in either order; a point counts as its moment."""
    start1, end1, start2, end2 = F.least(a, b), F.greatest(a, b), F.least(c, d), F.greatest(c, d)
    return (start1 == start2) | (F.when(start1 > start2, start1 < end2).otherwise(start2 < end1))
