"""Windows over event streams (an extension: the reference has batch equivalents only).

Every function takes a streaming or a batch DataFrame; over the same rows both give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(df: DataFrame, time: str, delay: str) -> DataFrame:
    rows = df.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, delay) if rows.isStreaming else rows


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], delay: str = "1 hour", **aggs) -> DataFrame:
    """Aggregates by window of fixed size; rows later than the watermark are dropped from a stream."""
    grouped = _timed(df, time, delay).groupBy(F.window(time, size), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return grouped.select(F.col("window.start").alias("start"), *keys, *aggs)


def sliding(df: DataFrame, time: str, size: str, step: str, keys: list[str], delay: str = "1 hour", **aggs) -> DataFrame:
    grouped = _timed(df, time, delay).groupBy(F.window(time, size, step), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return grouped.select(F.col("window.start").alias("start"), *keys, *aggs)


def session(df: DataFrame, time: str, gap: str, keys: list[str], delay: str = "1 hour", **aggs) -> DataFrame:
    """Windows that end when a key has no row for `gap`."""
    grouped = _timed(df, time, delay).groupBy(F.session_window(time, gap), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggs)


def first_of(df: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """One row per key: within the watermark's delay in a stream, of all rows in a batch."""
    rows = _timed(df, time, delay)
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count and sum of each key so far, kept as custom state; a row per key and micro-batch."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def keep_view(stream: DataFrame, path: str, keys: list[str], sums: dict[str, str]) -> None:
    """Upkeep of an aggregate view: each micro-batch adds its own partial sums below path, under its number, so a batch that
    runs twice after a failure replaces what it wrote. sums: name to SQL expression, summed; read with read_view."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(*[F.sum(F.expr(e)).alias(n) for n, e in sums.items()]).write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()


def read_view(spark: SparkSession, path: str, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """The view that keep_view holds: its parts added up."""
    return spark.read.parquet(f"{path}/parts").groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns its result (for tests and small results)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream of whole results (complete mode) over what is there now and returns the last one. Progress, state and
    result lie below path, which driver and executors share; each micro-batch replaces the result, and no row comes to the driver."""
    ran: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result")
        ran.append(number)

    stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    reader = stream.sparkSession.read.schema(stream.schema)
    return reader.parquet(f"{path}/result") if ran else stream.sparkSession.createDataFrame([], stream.schema)
