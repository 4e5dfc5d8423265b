"""Ordering with the reference's defaults, limits and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asc(c: str | Column) -> Column:
    """ASC: nulls last, as the reference has it."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: str | Column) -> Column:
    """DESC: nulls first."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def limit(df: DataFrame, n: int | None, offset: int = 0) -> DataFrame:
    """LIMIT n OFFSET m; None is ALL. A negative bound is an error (2201W, 2201X)."""
    if n is not None and n < 0:
        raise ValueError("2201W: LIMIT must not be negative")
    if offset < 0:
        raise ValueError("2201X: OFFSET must not be negative")
    out = df.offset(offset) if offset else df
    return out if n is None else out.limit(n)


def fetch_with_ties(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES, ascending by the order expressions: the n-th row's peers too.

    A bounded top-n finds the n-th order key (one small row), and a filter keeps what does not come
    after it: no sort of the whole, no task that sees all rows."""
    if n <= 0:
        return df.limit(0)
    key = F.struct(*order)
    last = df.select(key.alias("_key")).orderBy("_key").limit(n).agg(F.max("_key").alias("_last"))
    return df.join(F.broadcast(last), key <= F.col("_last")).drop("_last")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """ORDER BY ... LIMIT k: every task keeps k rows (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def using(c: str | Column, operator: str) -> Column:
    """ORDER BY c USING operator: < and <= ascend, > and >= descend, with the defaults for nulls."""
    if operator not in ("<", "<=", ">", ">="):
        raise ValueError(f"operator {operator} is not a valid ordering operator")
    return asc(c) if operator[0] == "<" else desc(c)
