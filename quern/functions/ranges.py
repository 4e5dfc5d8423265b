"""Ranges: structs of lower, upper, lower_inc, upper_inc and empty; a null bound is infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower: Column, upper: Column, bounds: str = "[)", discrete: bool = False) -> Column:
    """A range; a discrete one (whole numbers, dates) is brought to the form [)."""
    low_inc, up_inc = F.lit(bounds[0] == "["), F.lit(bounds[1] == "]")
    if discrete:
        step = lambda c: c + F.lit(1)
        lower = lower if bounds[0] == "[" else step(lower)
        upper = step(upper) if bounds[1] == "]" else upper
        low_inc, up_inc = F.lit(True), F.lit(False)
    empty = F.coalesce((lower > upper) | ((lower == upper) & ~(low_inc & up_inc)), F.lit(False))
    blank = lambda c: F.when(~empty, c)
    return F.struct(blank(lower).alias("lower"), blank(upper).alias("upper"), (low_inc & lower.isNotNull() & ~empty).alias("lower_inc"), (up_inc & upper.isNotNull() & ~empty).alias("upper_inc"), empty.alias("empty"))


def is_empty(r: Column) -> Column:
    return r["empty"]


def _starts_by(a: Column, b: Column) -> Column:
    """a's lower bound is not after b's."""
    return a["lower"].isNull() | (b["lower"].isNotNull() & ((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))))


def _ends_by(a: Column, b: Column) -> Column:
    """a's upper bound is not before b's."""
    return a["upper"].isNull() | (b["upper"].isNotNull() & ((a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (a["upper_inc"] | ~b["upper_inc"]))))


def contains_elem(r: Column, x: Column) -> Column:
    """r @> x"""
    low = r["lower"].isNull() | (r["lower"] < x) | ((r["lower"] == x) & r["lower_inc"])
    up = r["upper"].isNull() | (r["upper"] > x) | ((r["upper"] == x) & r["upper_inc"])
    return ~r["empty"] & low & up


def contains(a: Column, b: Column) -> Column:
    """a @> b"""
    return b["empty"] | (~a["empty"] & _starts_by(a, b) & _ends_by(a, b))


def before(a: Column, b: Column) -> Column:
    """a << b"""
    cut = (a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"]))
    return F.coalesce(~a["empty"] & ~b["empty"] & cut, F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    """a && b"""
    return ~a["empty"] & ~b["empty"] & ~before(a, b) & ~before(b, a)


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b"""
    touch = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def intersect(a: Column, b: Column) -> Column:
    """a * b"""
    low = F.when(_starts_by(a, b), b).otherwise(a)
    up = F.when(_ends_by(a, b), b).otherwise(a)
    meets = overlaps(a, b)
    blank = lambda c: F.when(meets, c)
    return F.struct(blank(low["lower"]).alias("lower"), blank(up["upper"]).alias("upper"), (meets & low["lower_inc"]).alias("lower_inc"), (meets & up["upper_inc"]).alias("upper_inc"), (~meets).alias("empty"))


def union(a: Column, b: Column) -> Column:
    """a + b; null for ranges that neither meet nor touch, where the reference has an error."""
    return F.when(a["empty"] | b["empty"] | overlaps(a, b) | adjacent(a, b), merge(a, b))


def merge(a: Column, b: Column) -> Column:
    """range_merge: the least range that holds both."""
    low = F.when(_starts_by(a, b), a).otherwise(b)
    up = F.when(_ends_by(a, b), a).otherwise(b)
    whole = F.struct(low["lower"].alias("lower"), up["upper"].alias("upper"), low["lower_inc"].alias("lower_inc"), up["upper_inc"].alias("upper_inc"), F.lit(False).alias("empty"))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(whole)


def to_text(r: Column) -> Column:
    side = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.when(r["empty"], "empty").otherwise(F.concat(F.when(r["lower_inc"], "[").otherwise("("), side(r["lower"]), F.lit(","), side(r["upper"]), F.when(r["upper_inc"], "]").otherwise(")")))


def multirange_contains(ranges: Column, x: Column) -> Column:
    return F.exists(ranges, lambda r: contains_elem(r, x))
