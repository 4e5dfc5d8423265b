"""User-defined functions, aggregates and table functions: one-off wrappers over Arrow batches and SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sql_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """CREATE FUNCTION in SQL; Spark inlines the body where it is called."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def sql_table_function(spark: SparkSession, name: str, arguments: str, columns: str, body: str) -> None:
    """CREATE FUNCTION ... RETURNS TABLE in SQL."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")


def fold(values: Column, init: Column, step: Callable[[Column, Column], Column], final: Callable[[Column], Column] | None = None) -> Column:
    """CREATE AGGREGATE over an array of values (collect_list of the group): sfunc and finalfunc as
    expressions. For groups whose values fit one row; see combinable() for others."""
    return F.aggregate(values, init, step, final) if final else F.aggregate(values, init, step)


def strict_fold(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A strict aggregate without an initial state: the first value that is not null becomes the state."""
    kept = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), F.element_at(kept, 1), step))


def combinable(df: DataFrame, keys: list[str], schema: str, start: Callable[[pd.DataFrame], pd.DataFrame], combine: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """An aggregate with a combine function: every task makes partial states of its batches with start()
    (key columns and state columns, of `schema`), and combine() merges a key's states, so a key with a
    third of all rows sends one state a batch."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield start(batch)

    return df.mapInPandas(partial, schema).groupBy(*keys).applyInPandas(combine, schema)


def series_function(returns, f: Callable[[pd.Series], pd.Series]):
    """A scalar function over whole batches."""
    return F.pandas_udf(f, returns)
