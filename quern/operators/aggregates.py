"""Aggregates with the reference's semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def array_agg(x: Column, *order: Column) -> Column:
    """array_agg(x ORDER BY order): nulls are kept; without an order, in any."""
    if order:
        rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], x.alias("v"))))
    else:
        rows = F.collect_list(F.struct(x.alias("v")))
    return F.transform(rows, lambda r: r["v"])


def string_agg(x: Column, delimiter: str, *order: Column) -> Column:
    """string_agg(x, delimiter ORDER BY order): nulls are passed over; null for no value."""
    values = F.filter(array_agg(x, *order), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.array_join(values, delimiter))


def json_agg(x: Column, *order: Column) -> Column:
    return F.to_json(array_agg(x, *order))


def json_object_agg(key: Column, value: Column) -> Column:
    """One object of all pairs, keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.cast("string").alias("key"), value.alias("value"))))))


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """SELECT DISTINCT ON (keys) ... ORDER BY keys, order: the first row of each key.

    A rank filter, which Spark turns into a per-task group limit before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def mode(x: Column) -> Column:
    """mode() WITHIN GROUP (ORDER BY x): of the most frequent values the least."""
    return F.mode(x, True)


def hypothetical(kind: str, x: Column, value: Column, descending: bool = False) -> Column:
    """rank, dense_rank, percent_rank or cume_dist of `value` as if it were in the group ordered by x
    (nulls last ascending, first descending)."""
    before = (x.isNull() | (x > value)) if descending else (x < value)
    n, less = F.count("*"), F.count_if(F.coalesce(before, F.lit(False)))
    if kind == "rank":
        return less + 1
    if kind == "dense_rank":
        below = F.count_distinct(F.when(before & x.isNotNull(), x))
        return below + 1 + (F.count_if(x.isNull()).cast("boolean").cast("int") if descending else 0)
    if kind == "percent_rank":
        return F.when(n > 0, less / n).otherwise(F.lit(0.0))
    return (less + F.count_if(x == value) + 1) / (n + 1)


def sum_exact(x: Column) -> Column:
    """sum of bigint as numeric: no overflow."""
    return F.sum(x.cast("decimal(38,0)"))


def range_agg(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """range_agg of half-open [low, high): disjoint ranges per key, by gaps and islands in one shuffle."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(low) < F.col(high)).withColumn("_new", F.when(reach >= F.col(low), 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")


def range_intersect_agg(low: Column, high: Column) -> Column:
    """range_intersect_agg of half-open [low, high): struct of low and high, both null where nothing is common."""
    first, last = F.max(low), F.min(high)
    return F.struct(F.when(first < last, first).alias("low"), F.when(first < last, last).alias("high"))


def vector_avg(df: DataFrame, keys: list[str], col: str, how=F.avg) -> DataFrame:
    """Element-wise mean (or sum: how=F.sum) of arrays: partial sums by position, then one array a key."""
    at = df.select(*keys, F.posexplode(col).alias("_i", "_x"))
    means = at.groupBy(*keys, "_i").agg(how("_x").alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda r: r["_m"]).alias(col))
