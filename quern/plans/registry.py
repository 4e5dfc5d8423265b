"""Registration of queries with the SQL that an independent engine answers them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Input tables by attribute: t.lineitem reads lineitem.parquet lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Spark SQL over {name} placeholders; every input table is known by its own."""
        used = {n: getattr(self, n) for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **used, **frames)


def query(oracle: str | None = None) -> Callable:
    """Registers f(t: Tables) -> DataFrame under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def portable(name: str, text: str, oracle: str | None = None) -> None:
    """Registers one SQL statement; tables are written {lineitem}. oracle: where the dialects differ."""
    QUERIES[name] = lambda spark, sf_dir: Tables(spark, sf_dir).sql(text)
    plain = oracle or text
    for n in TABLES:
        plain = plain.replace("{" + n + "}", n)
    ORACLES[name] = plain
