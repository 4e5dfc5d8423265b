"""Sort, limit and top-k (blueprint 2.8). Queries whose order matters return a row number."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import sorting as s
from quern.plans.registry import Tables, portable, query

portable("sort_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40")
portable("sort_limit_offset", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 35")
portable("sort_limit_all", "SELECT r_name FROM {region} ORDER BY r_name")
portable("sort_incremental_prefix", "SELECT o_custkey, o_orderdate, o_orderkey FROM {orders} ORDER BY o_custkey, o_orderdate, o_orderkey LIMIT 100")
portable("sort_append_ordered_merge", "SELECT k FROM (SELECT n_name AS k FROM {nation} UNION ALL SELECT r_name FROM {region}) AS u ORDER BY k LIMIT 12")
portable("sort_expression_key", "SELECT p_partkey FROM {part} ORDER BY p_size % 7, p_retailprice DESC, p_partkey LIMIT 30")


@query("SELECT x, CAST(row_number() OVER (ORDER BY x ASC NULLS LAST) AS INT) AS a, CAST(row_number() OVER (ORDER BY x DESC NULLS FIRST) AS INT) AS d FROM (VALUES (3), (NULL), (1), (2)) v(x)")
def sort_null_defaults(t: Tables):
    rows = t.spark.createDataFrame([(3,), (None,), (1,), (2,)], "x int")
    return rows.select("x", F.row_number().over(Window.orderBy(s.asc("x"))).alias("a"), F.row_number().over(Window.orderBy(s.desc("x"))).alias("d"))


@query("SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS r FROM part) WHERE r <= 10")
def sort_fetch_with_ties(t: Tables):
    return s.fetch_with_ties(t.part.select("p_partkey", "p_size"), 10, F.col("p_size"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 3")
def sort_limit_api(t: Tables):
    return s.limit(t.orders.select("o_orderkey", "o_totalprice").orderBy(s.desc("o_totalprice"), s.asc("o_orderkey")), 5, 3)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20")
def sort_collation_c(t: Tables):
    return s.top_k(t.part.select("p_partkey", "p_name"), 20, F.collate("p_name", "UTF8_BINARY"), F.col("p_partkey"))


@query("SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS BIGINT) AS n FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 30")
def sort_using_operator(t: Tables):
    top = t.orders.select("o_orderkey", "o_totalprice").orderBy(s.using("o_totalprice", ">"), s.using("o_orderkey", "<")).limit(30)
    return top.withColumn("n", F.row_number().over(Window.orderBy(s.using("o_totalprice", ">"), s.using("o_orderkey", "<"))).cast("bigint"))
