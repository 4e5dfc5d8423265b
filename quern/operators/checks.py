"""Constraints, row policies, sequences and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources import files


def ensure(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """CHECK: a row for which the condition is false (not null) is an error when it is read."""
    return df.where(F.when(F.coalesce(condition, F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break UNIQUE (nulls are distinct from each other)."""
    return df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).count().where("count > 1")


def orphans(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows of child that break the foreign key: a key without a null and without a parent."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in on])
    return child.where(" AND ".join(f"{c} IS NOT NULL" for c, _ in on)).join(keys, [c for c, _ in on], "left_anti")


def with_policy(df: DataFrame, using: Column) -> DataFrame:
    """Row-level security: only rows for which the policy is true; the filter reaches the scan."""
    return df.where(using)


def number_rows(df: DataFrame, name: str, order: list[str], start: int = 1, chunk: int = 1_000_000) -> DataFrame:
    """Gapless sequence values in an order, without one task that sees all rows; equal rows in any order.

    Rows are dealt by ranges of about `chunk` rows and written once with their range's number to a table in the
    shared folder. Counts and rows are both read from it, so each row gets its range's start plus its
    place there, however the ranges were sampled and whatever task runs again."""
    part, row, before = (next(n for n in (base + "_" * i for i in range(99)) if n.lower() not in {c.lower() for c in df.columns}) for base in ("_part", "_row", "_before"))
    parts = max(1, -(-df.count() // chunk))
    dealt = files.cut(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    # One row per range: the running sum is over as many rows as there are ranges.
    earlier = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(part, F.coalesce(earlier, F.lit(0)).alias(before))
    local = dealt.withColumn(row, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return local.join(F.broadcast(starts), part).select(*df.columns, (F.col(before) + F.col(row) + (start - 1)).alias(name))


def nextval(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Sequence values that are distinct and ascend within a task, with gaps: no shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id() + start)


def period_conflicts(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Rows that break PRIMARY KEY (keys, period WITHOUT OVERLAPS): a half-open period [low, high) that
    starts before an earlier one of the same keys has ended."""
    before = Window.partitionBy(*keys).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    return df.where(F.col(low) < F.col(high)).withColumn("_ended", F.max(high).over(before)).where(F.col("_ended") > F.col(low)).drop("_ended")
