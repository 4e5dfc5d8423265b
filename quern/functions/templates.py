"""Dates and numbers by template: to_date, to_timestamp and the numeric to_char."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.strings import date_template


def to_timestamp(s: Column, template: str) -> Column:
    """to_timestamp(text, template) as a timestamp without time zone; null where the text does not fit."""
    return F.try_to_timestamp(s, F.lit(date_template(template))).cast("timestamp_ntz")


def to_date(s: Column, template: str) -> Column:
    """to_date(text, template); null where the text does not fit."""
    return to_timestamp(s, template).cast("date")


def from_epoch(seconds: Column) -> Column:
    """to_timestamp(seconds since 1970), to the microsecond, in UTC without time zone. Whole seconds are counted as integers:
    a double holds no microseconds beyond 2^53 of them."""
    part = seconds.cast("double") % F.lit(1.0)
    micros = (seconds.cast("double") - part).cast("bigint") * F.lit(1_000_000) + F.round(part * 1e6).cast("bigint")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def number_to_char(x: Column, template: str) -> Column:
    """to_char(number, template) with 9 0 , . FM MI PR: rounded half away from zero, as wide as the template and a
    sign; null of null. The sign stands before the first digit, after the number (MI) or as angle brackets (PR). A number
    that has more digits than the template shows # in their place. FM drops the padding, and zeros at the end that 9 stands for.
    A double keeps its sign when it rounds to zero, and negative zero has one; a zero of another type has none."""
    fill, minus, brackets = (word in template for word in ("FM", "MI", "PR"))
    body = re.sub("FM|MI|PR", "", template)
    if not body or re.search("[^90,.]", body) or body.count(".") > 1:
        raise ValueError(f"template {template!r} is not one of 9 0 , . FM MI PR")
    whole, point, fraction = body.partition(".")
    slots = re.sub(",", "", whole)
    places, zeros = len(re.sub(",", "", fraction)), len(slots) - slots.index("0") if "0" in slots else 0

    def front_of(digits: Column) -> Column:
        front = F.regexp_replace(F.substring_index(digits, ".", 1), "^0+", "")
        return F.when(F.length(front) < zeros, F.lpad(front, zeros, "0")).otherwise(front)

    def separated(padded: Column) -> Column:
        parts, at = [F.lit("")], 0
        for c in whole:
            if c == ",":
                parts.append(F.when(F.ltrim(F.substring(padded, 1, at)) != "", ",").otherwise(" "))
            else:
                at += 1
                parts.append(F.substring(padded, at, 1))
        return F.concat(*parts)

    def joined(value: Column, digits: Column, number: Column) -> Column:
        if not point:
            return F.when(F.ltrim(number) == "", "0").otherwise(number)
        tail = F.substring_index(digits, ".", -1) if places else F.lit("")
        if fill:
            forced = fraction.rindex("0") + 1 if "0" in fraction else 0
            tail = F.concat(F.substring(tail, 1, forced), F.regexp_replace(F.substring(tail, forced + 1, places), "0+$", ""))
            # A number of no digits at all is a 0.
            number = F.when((F.ltrim(number) == "") & (value == 0) & (forced == 0), "0").otherwise(number)
        return F.concat(number, F.lit("."), tail)

    def signed(value: Column, number: Column) -> Column:
        below = F.when(F.typeof(x).isin("double", "float"), F.startswith(x.cast("string"), F.lit("-"))).otherwise(value < 0)
        if brackets:
            return F.when(below, F.concat(F.lit("<"), number, F.lit(">"))).otherwise(F.concat(F.lit(" "), number, F.lit(" ")))
        if minus:
            return F.concat(number, F.when(below, "-").otherwise(" "))
        return F.concat(F.when(below, "-").otherwise(" "), number)

    def text(value: Column, digits: Column, front: Column) -> Column:
        shown = _let(separated(F.lpad(front, max(len(slots), 1), " ")), lambda n: joined(value, digits, n))
        fitting = F.when(F.length(front) <= len(slots), F.ltrim(shown)).otherwise(re.sub("[90]", "#", body))
        return _let(fitting, lambda n: signed(value, n))

    value = F.round(x.cast(f"decimal(38,{max(places, 9)})"), places)
    digits = lambda v: F.abs(v).cast(f"decimal(38,{places})").cast("string")
    out = _let(value, lambda v: _let(digits(v), lambda d: _let(front_of(d), lambda f: text(v, d, f))))
    width = len(body) + (2 if brackets else 1)
    return F.when(x.isNotNull(), F.trim(out) if fill else F.lpad(out, width, " "))
