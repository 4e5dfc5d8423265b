"""Cursors, EXPLAIN, statistics and tables laid out for co-located joins."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession


class Cursor:
    """DECLARE ... CURSOR: rows are fetched a partition at a time, not all at once."""

    def __init__(self, df: DataFrame):
        self._rows = df.toLocalIterator(prefetchPartitions=True)

    def fetch(self, n: int = 1) -> list[Row]:
        """FETCH FORWARD n"""
        return list(islice(self._rows, n))

    def move(self, n: int) -> int:
        """MOVE FORWARD n: how many rows were passed over."""
        return sum(1 for _ in islice(self._rows, n))


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """EXPLAIN: the plan as text."""
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def analyze(spark: SparkSession, table: str, *columns: str) -> None:
    """ANALYZE: row count, and for columns distinct counts, nulls, extremes and histograms."""
    what = f" FOR COLUMNS {', '.join(columns)}" if columns else ""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS{what}")


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, sort: list[str] | None = None) -> DataFrame:
    """A table in hash buckets of the keys: joins and groups on them need no shuffle (partition-wise join)."""
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*(sort or keys)).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)
