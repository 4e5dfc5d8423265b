"""Numeric functions of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """a / b of whole numbers: cut towards zero."""
    return F.call_function("div", a, b)


def round_half_even(x: Column) -> Column:
    """round(double): halves to the even neighbour."""
    return F.rint(x)


def log10(x: Column) -> Column:
    """log(x) with one argument is of base 10."""
    return F.log10(x)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps in one expression: 92 suffice for 64 bits; never negative."""
    pair = F.struct(F.abs(a.cast("bigint")).alias("x"), F.abs(b.cast("bigint")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs(F.call_function("div", a.cast("bigint"), gcd(a, b)) * b))


#: Sines of whole multiples of 30 degrees.
_SIN = {0: 0.0, 30: 0.5, 90: 1.0, 150: 0.5, 180: 0.0, 210: -0.5, 270: -1.0, 330: -0.5}


def sind(x: Column) -> Column:
    """Sine of degrees, exact at multiples of 30 and 90."""
    turn = F.pmod(x.cast("double"), F.lit(360.0))
    out = F.sin(F.radians(turn))
    for degrees, value in _SIN.items():
        out = F.when(turn == degrees, F.lit(value)).otherwise(out)
    return out


def cosd(x: Column) -> Column:
    return sind(x.cast("double") + 90)


def atan2d(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def num_nulls(*xs: Column) -> Column:
    return sum((x.isNull().cast("int") for x in xs), F.lit(0))


def num_nonnulls(*xs: Column) -> Column:
    return sum((x.isNotNull().cast("int") for x in xs), F.lit(0))


def size_pretty(n: Column) -> Column:
    """pg_size_pretty: the largest unit that leaves at least 10 of it, rounded."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for i, unit in enumerate(("kB", "MB", "GB", "TB", "PB"), 1):
        size = 1024**i
        text = F.concat(F.floor((n + size // 2) / F.lit(size)).cast("string"), F.lit(f" {unit}"))
        out = F.when(F.abs(n) >= 10 * size, text).otherwise(out)
    return out


def trim_scale(x: Column) -> Column:
    """A decimal's text without zeros at its end."""
    text = x.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def scale(x: Column) -> Column:
    """Digits after the point in a decimal's text."""
    return F.length(F.regexp_extract(x.cast("string"), r"\.(\d+)$", 1))


def money(x: Column) -> Column:
    return x.cast("decimal(19,2)")


def normal_rand(spark, n: int, mean: float, deviation: float, seed: int | None = None) -> DataFrame:
    """normal_rand(n, mean, deviation): n rows of one column x; seed is what setseed() is for."""
    return spark.range(n).select((F.randn(seed) * deviation + mean).alias("x"))
