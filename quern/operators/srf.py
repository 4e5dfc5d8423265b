"""Set-returning functions in the select list (ProjectSet)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.scans import rows_from


def project_set(df: DataFrame, keep: list[str], **functions: Column) -> DataFrame:
    """SELECT keep, f1(), f2() ...: all run in lock step, the shorter padded with null; a row for which
    all are empty gives none. Expansion comes before DISTINCT, ORDER BY and LIMIT."""
    return rows_from(df.select(*keep, *[c.alias(f"_f_{n}") for n, c in functions.items()]), **{n: F.col(f"_f_{n}") for n in functions}).select(*keep, *functions)


def series(start: Column | int, stop: Column | int, step: int = 1) -> Column:
    """generate_series as an array: empty where stop is not on step's side of start."""
    a, b = (c if isinstance(c, Column) else F.lit(c).cast("bigint") for c in (start, stop))
    fits = a <= b if step > 0 else a >= b
    return F.when(fits, F.sequence(a, b, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def regexp_split(s: Column, pattern: str) -> Column:
    return F.split(s, pattern)
