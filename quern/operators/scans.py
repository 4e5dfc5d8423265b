"""Scans that need more than a reader: ordinality, zipped table functions, samples, row ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_ordinality(df: DataFrame, array: Column, value: str, ordinal: str = "ordinality", outer: bool = False) -> DataFrame:
    """FROM df, unnest(array) WITH ORDINALITY: a row per element, numbered from 1."""
    explode = F.posexplode_outer if outer else F.posexplode
    return df.select("*", explode(array).alias("_pos", value)).withColumn(ordinal, (F.col("_pos") + 1).cast("bigint")).drop("_pos")


def rows_from(df: DataFrame, ordinal: str | None = None, **arrays: Column) -> DataFrame:
    """ROWS FROM (f1, f2, ...): the functions in lock step, the shorter padded with NULL."""
    names = list(arrays)
    size = F.greatest(*[F.size(a) for a in arrays.values()], F.lit(0)) if len(names) > 1 else F.size(next(iter(arrays.values())))
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    out = df.select("*", F.explode(places).alias("_pos"), *[a.alias(f"_a_{n}") for n, a in arrays.items()])
    out = out.withColumns({n: F.get(F.col(f"_a_{n}"), F.col("_pos") - 1) for n in names})
    if ordinal:
        out = out.withColumn(ordinal, F.col("_pos").cast("bigint"))
    return out.drop("_pos", *[f"_a_{n}" for n in names])


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "i") -> DataFrame:
    """generate_series(start, stop, step), split over the cluster."""
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias(name))


def sample_bernoulli(df: DataFrame, percent: float, seed: int, *key: str) -> DataFrame:
    """Rows chosen one by one by a seeded hash of the key: the same rows at every run and partitioning."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_000)) < F.lit(int(percent * 10_000)))


def sample_system(df: DataFrame, percent: float, seed: int, block: Column) -> DataFrame:
    """Whole blocks of rows: all rows of a block are in the sample or none is."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), block), F.lit(1_000_000)) < F.lit(int(percent * 10_000)))


def sample_rows(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """SYSTEM_ROWS(n): exactly n rows (all, if fewer) by the order of a seeded hash: a bounded top-n, no sort of all."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def nearest(df: DataFrame, distance: Column, k: int, *ties: str) -> DataFrame:
    """ORDER BY distance LIMIT k: each task keeps k rows (TakeOrderedAndProject)."""
    return df.withColumn("distance", distance).orderBy("distance", *ties).limit(k)


def row_range(df: DataFrame, first: int, last: int, name: str = "row_index") -> DataFrame:
    """Rows by their place in the file, as a row-id range scan; places hold for one file version."""
    return df.select("*", F.col("_metadata.row_index").alias(name)).where(F.col(name).between(first, last))


def union_scans(*scans: DataFrame) -> DataFrame:
    """Append of partition scans by name."""
    return reduce(lambda a, b: a.unionByName(b), scans)
