"""Geometric, network and check-digit types as structs and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    """a <-> b of two points"""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def box_area(a: Column, b: Column) -> Column:
    """Of the box with corners a and b."""
    return F.abs(a["x"] - b["x"]) * F.abs(a["y"] - b["y"])


def box_contains(a: Column, b: Column, p: Column) -> Column:
    """box(a, b) @> p, the edge included."""
    inside = lambda k: p[k].between(F.least(a[k], b[k]), F.greatest(a[k], b[k]))
    return inside("x") & inside("y")


def circle_area(radius: Column) -> Column:
    return F.pi() * radius * radius


def slope(a: Column, b: Column) -> Column:
    """Infinite for a vertical line."""
    return F.when(a["x"] == b["x"], F.lit(float("inf"))).otherwise((b["y"] - a["y"]) / (b["x"] - a["x"]))


def path_length(points: Column, closed: bool = False) -> Column:
    """Of the straight pieces between the points of an array, and back to the first if closed."""
    pieces = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), distance)
    total = F.aggregate(pieces, F.lit(0.0), lambda s, d: s + d)
    return total + distance(F.element_at(points, -1), F.element_at(points, 1)) if closed else total


def polygon_area(points: Column) -> Column:
    """By the shoelace sum."""
    following = F.concat(F.slice(points, F.lit(2), F.size(points) - 1), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)) / 2


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6378.168) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def inet_number(address: Column) -> Column:
    """An IPv4 address (a mask aside) as a number."""
    parts = F.split(F.split_part(address, F.lit("/"), F.lit(1)), r"\.")
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n * 256 + p.cast("bigint"))


def inet_text(n: Column) -> Column:
    byte = lambda shift: F.shiftright(n, shift).bitwiseAND(255).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def masklen(address: Column) -> Column:
    return F.when(F.contains(address, F.lit("/")), F.split_part(address, F.lit("/"), F.lit(2)).cast("int")).otherwise(32)


def _mask(bits: Column) -> Column:
    return F.lit(4294967295).bitwiseAND(F.lit(4294967295) * F.pow(F.lit(2), 32 - bits).cast("bigint"))


def netmask(address: Column) -> Column:
    return inet_text(_mask(masklen(address)))


def network(address: Column) -> Column:
    return F.concat(inet_text(inet_number(address).bitwiseAND(_mask(masklen(address)))), F.lit("/"), masklen(address).cast("string"))


def broadcast_address(address: Column) -> Column:
    return inet_text(inet_number(address).bitwiseOR(F.lit(4294967295).bitwiseXOR(_mask(masklen(address)))))


def subnet_contains(net: Column, address: Column) -> Column:
    """net >> address or equal to it"""
    m = _mask(masklen(net))
    return (inet_number(net).bitwiseAND(m) == inet_number(address).bitwiseAND(m)) & (masklen(net) <= masklen(address))


def macaddr(text: Column) -> Column:
    """Six or eight bytes with colons, in lower case."""
    digits = F.lower(F.regexp_replace(text, "[^0-9A-Fa-f]", ""))
    return F.rtrim(F.regexp_replace(digits, "(..)", "$1:"), F.lit(":"))


def ean13_valid(code: Column) -> Column:
    """Whether the last of 13 digits is the check digit of the others (ISBN-13 too)."""
    digits = F.transform(F.filter(F.split(F.regexp_replace(code, "[^0-9]", ""), ""), lambda c: c != ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda s, d: s + d)
    return (F.size(digits) == 13) & (total % 10 == 0)


def enum_order(x: Column, *labels: str) -> Column:
    """The place of a label in its type's declaration, to order and compare by."""
    return F.array_position(F.array(*[F.lit(v) for v in labels]), x)
