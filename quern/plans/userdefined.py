"""User-defined functions, aggregates and table functions (blueprint 2.14)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quern.functions import udfs
from quern.plans.registry import Tables, query


@query("SELECT c_custkey, round(c_acctbal * 1.1 + 5, 4) AS x FROM customer")
def udf_sql_function(t: Tables):
    udfs.sql_function(t.spark, "quern_markup", "x DOUBLE", "DOUBLE", "x * 1.1 + 5")
    return t.customer.select("c_custkey", F.round(F.expr("quern_markup(c_acctbal)"), 4).alias("x"))


@query("SELECT n_nationkey, i FROM (SELECT n_nationkey, unnest(generate_series(1, n_regionkey)) AS i FROM nation)")
def udf_table_function(t: Tables):
    udfs.sql_table_function(t.spark, "quern_upto", "n BIGINT", "i BIGINT", "SELECT explode(CASE WHEN n > 0 THEN sequence(1, n) ELSE array() END)")
    return t.sql("SELECT n_nationkey, i FROM {nation}, LATERAL quern_upto(CAST(n_regionkey AS BIGINT))")


@query("SELECT p_partkey, p_retailprice * p_retailprice AS sq FROM part")
def udf_pandas_scalar(t: Tables):
    def square(x: pd.Series) -> pd.Series:
        return x * x

    return t.part.select("p_partkey", udfs.series_function(DoubleType(), square)("p_retailprice").alias("sq"))


@query("SELECT n_regionkey, CAST(sum(n_nationkey * n_nationkey) AS BIGINT) AS s FROM nation GROUP BY 1")
def udaf_fold(t: Tables):
    state = F.lit(0).cast("bigint")
    return t.nation.groupBy("n_regionkey").agg(udfs.fold(F.collect_list("n_nationkey"), state, lambda s, x: s + x * x).alias("s"))


@query("SELECT k, CAST(m AS INT) AS m FROM (VALUES (1, 9), (2, NULL)) v(k, m)")
def udaf_strict(t: Tables):
    rows = t.spark.createDataFrame([(1, None), (1, 4), (1, 9), (2, None)], "k int, x int")
    from quern.operators.aggregates import array_agg

    return rows.groupBy("k").agg(udfs.strict_fold(array_agg(F.col("x"), F.col("x")), lambda s, x: F.greatest(s, x)).alias("m"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_quantity), 2) AS ss, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def udaf_combine(t: Tables):
    def start(batch: pd.DataFrame) -> pd.DataFrame:
        sq = batch.assign(ss=batch["l_quantity"] ** 2, n=1)
        return sq.groupby("l_returnflag", as_index=False)[["ss", "n"]].sum()

    def combine(states: pd.DataFrame) -> pd.DataFrame:
        return states.groupby("l_returnflag", as_index=False)[["ss", "n"]].sum()

    rows = t.lineitem.select("l_returnflag", "l_quantity")
    return udfs.combinable(rows, ["l_returnflag"], "l_returnflag string, ss double, n bigint", start, combine).select("l_returnflag", F.round("ss", 2).alias("ss"), "n")


@query("SELECT o_custkey, CAST(greatest(max(o_orderkey), 0) AS BIGINT) AS m FROM orders GROUP BY 1")
def udf_variadic_polymorphic(t: Tables):
    """A variadic function over any ordered type."""
    largest = lambda *xs: F.greatest(*xs)
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("m")).select("o_custkey", largest(F.col("m"), F.lit(0).cast("bigint")).alias("m"))
