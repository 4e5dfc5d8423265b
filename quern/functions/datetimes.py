"""Date and time functions of the reference; intervals as months, days and microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone (or with: in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def extract(field: str, ts: Column) -> Column:
    """extract(field FROM ts): dow is 0 on Sunday, isodow 7; epoch in seconds; also decade, century, millennium."""
    year = F.year(ts)
    known = {
        "dow": lambda: F.dayofweek(ts) - 1, "isodow": lambda: (F.dayofweek(ts) + 5) % 7 + 1, "doy": lambda: F.dayofyear(ts), "week": lambda: F.weekofyear(ts),
        "isoyear": lambda: F.year(F.date_add(ts.cast("date"), 3 - (F.dayofweek(ts) + 5) % 7)),
        "epoch": lambda: micros(ts) / 1e6, "decade": lambda: F.floor(year / 10), "century": lambda: F.ceil(year / 100), "millennium": lambda: F.ceil(year / 1000),
        "year": lambda: year, "quarter": lambda: F.quarter(ts), "month": lambda: F.month(ts), "day": lambda: F.dayofmonth(ts), "hour": lambda: F.hour(ts), "minute": lambda: F.minute(ts), "second": lambda: F.second(ts),
    }
    return known[field]()


def date_trunc(field: str, ts: Column) -> Column:
    """date_trunc(), with decade, century and millennium."""
    if field in ("decade", "century", "millennium"):
        size = {"decade": 10, "century": 100, "millennium": 1000}[field]
        shift = 0 if field == "decade" else 1
        return F.make_date((F.floor((F.year(ts) - shift) / size) * size + shift).cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc(field, ts)


def date_bin(step_seconds: float, ts: Column, origin: Column) -> Column:
    """The start of the bin of a fixed width, counted from origin, that holds ts."""
    step = int(step_seconds * 1_000_000)
    at = micros(origin)
    return F.timestamp_micros(at + F.floor((micros(ts) - at) / F.lit(step)) * step).cast("timestamp_ntz")


def age(a: Column, b: Column) -> Column:
    """age(a, b): struct of months, days and micros, field by field; a day that is borrowed counts the
    month of the earlier time. Negative if a is before b."""
    swap = a < b
    high, low = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    clock = lambda ts: micros(ts) - micros(F.date_trunc("day", ts).cast("timestamp_ntz"))
    rest = clock(high) - clock(low)
    days = F.dayofmonth(high) - F.dayofmonth(low) - F.when(rest < 0, 1).otherwise(0)
    months = (F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low) - F.when(days < 0, 1).otherwise(0)
    days = F.when(days < 0, days + F.dayofmonth(F.last_day(low.cast("date")))).otherwise(days)
    rest = F.when(rest < 0, rest + DAY).otherwise(rest)
    sign = F.when(swap, -1).otherwise(1)
    return F.struct((sign * months).cast("int").alias("months"), (sign * days).cast("int").alias("days"), (sign * rest).cast("bigint").alias("micros"))


def shift_months(ts: Column, months: Column) -> Column:
    """ts + months, with the day cut to the month's last and the time of day kept."""
    day = F.date_trunc("day", ts)
    return F.timestamp_micros(micros(F.add_months(ts.cast("date"), months).cast("timestamp")) + micros(ts) - micros(day)).cast("timestamp_ntz")


def interval(months: Column | int = 0, days: Column | int = 0, micros_: Column | int = 0) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(months).cast("int").alias("months"), c(days).cast("int").alias("days"), c(micros_).cast("bigint").alias("micros"))


def interval_order(i: Column) -> Column:
    """What intervals are ordered and compared by: a month counts 30 days, a day 24 hours."""
    return i["months"].cast("decimal(38,0)") * 30 * DAY + i["days"].cast("decimal(38,0)") * DAY + i["micros"]


def justify_hours(i: Column) -> Column:
    """Whole days out of the hours."""
    more = F.floor(i["micros"] / DAY)
    return interval(i["months"], i["days"] + more, i["micros"] - more * DAY)


def justify_days(i: Column) -> Column:
    """Whole months out of the days, of 30 each."""
    more = F.floor(i["days"] / 30)
    return interval(i["months"] + more, i["days"] - more * 30, i["micros"])


def justify_interval(i: Column) -> Column:
    return justify_days(justify_hours(i))


def at_time_zone(ts: Column, zone: str) -> Column:
    """timestamp AT TIME ZONE zone: the moment at which clocks there show ts."""
    return F.to_utc_timestamp(ts.cast("timestamp"), zone)


def days_between(a: Column, b: Column) -> Column:
    """date - date: whole days."""
    return F.datediff(a, b)


def series(start: Column, stop: Column, step: str) -> Column:
    """generate_series over time; explode it for rows."""
    return F.sequence(start, stop, F.expr(f"INTERVAL {step}"))


def isfinite(x: Column) -> Column:
    """isfinite(date, timestamp or float): dates and times have no infinities here."""
    text = F.lower(x.cast("string"))
    return F.when(x.isNotNull(), ~text.isin("infinity", "-infinity", "nan"))


def make_timestamptz(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, zone: str) -> Column:
    """make_timestamptz(..., zone): the moment at which clocks in the zone show that."""
    return F.make_timestamp(year, month, day, hour, minute, second.cast("decimal(16,6)"), F.lit(zone))
