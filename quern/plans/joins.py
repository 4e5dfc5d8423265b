"""Joins (blueprint 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import joins
from quern.plans.registry import Tables, portable, query

SMALL = "(SELECT * FROM {orders} WHERE o_totalprice > 300000)"
portable("join_inner_hash", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > 200000")
portable("join_inner_residual", "SELECT c_custkey, s_suppkey FROM {customer} JOIN {supplier} ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal")
portable("join_left", f"SELECT c_custkey, o_orderkey FROM {{customer}} LEFT JOIN {SMALL} o ON c_custkey = o_custkey")
portable("join_left_residual", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 350000")
portable("join_right", f"SELECT o_orderkey, c_custkey FROM {SMALL} o RIGHT JOIN {{customer}} ON c_custkey = o_custkey")
portable("join_full", "SELECT c_custkey, s_suppkey, coalesce(c_nationkey, s_nationkey) AS nk FROM {customer} FULL JOIN {supplier} ON c_custkey + 5 = s_suppkey")
portable("join_full_group_order", "SELECT coalesce(c_nationkey, s_nationkey) AS nk, count(c_custkey) AS c, count(s_suppkey) AS s FROM {customer} FULL JOIN {supplier} ON c_custkey = s_suppkey GROUP BY coalesce(c_nationkey, s_nationkey) ORDER BY nk")
portable("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
portable("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
portable("join_star_multi_probe", "SELECT r_name, p_brand, s_nationkey, count(*) AS n FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE p_size > 45 GROUP BY r_name, p_brand, s_nationkey")
portable("join_nested_loop_theta", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM {nation} a JOIN {region} b ON a.n_regionkey < b.r_regionkey")
portable("join_nested_loop_left", "SELECT a.r_regionkey AS a, b.n_nationkey AS b FROM {region} a LEFT JOIN {nation} b ON b.n_nationkey > a.r_regionkey + 20")
portable("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM {region} a CROSS JOIN {region} b")
portable("join_using", "SELECT l_orderkey, n, q FROM (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) a JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS q FROM {lineitem} WHERE l_discount > 0.05 GROUP BY l_orderkey) b USING (l_orderkey)")
portable("join_natural", "SELECT k, a, b FROM (SELECT n_regionkey AS k, count(*) AS a FROM {nation} GROUP BY n_regionkey) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM {region}) y")
portable("join_lateral_limit", "SELECT c_custkey, o_orderkey, o_totalprice FROM {customer}, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) AS top")
portable("join_lateral_left", "SELECT c_custkey, best FROM {customer} LEFT JOIN LATERAL (SELECT max(o_totalprice) AS best FROM {orders} WHERE o_custkey = c_custkey) AS m ON true")
portable("join_expression_keys", "SELECT o_orderkey, e.event_id FROM {orders} JOIN {events} e ON o_custkey + 1 = e.user_id * 2")
portable("join_null_keys", "SELECT a.k AS a, b.k AS b FROM (VALUES (1), (NULL), (2)) AS a(k) LEFT JOIN (VALUES (1), (NULL)) AS b(k) ON a.k = b.k")
portable("join_nan_zero_keys", "SELECT a.k AS k FROM (SELECT CAST('NaN' AS DOUBLE) AS k UNION ALL SELECT -0.0 AS k) a JOIN (SELECT CAST('NaN' AS DOUBLE) AS k UNION ALL SELECT 0.0 AS k) b ON a.k = b.k")
portable("join_runtime_filter", "SELECT l_orderkey, l_linenumber FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE p_brand = 'Brand#12' AND p_size = 5")


@query("SELECT event_id, o_orderkey FROM (SELECT event_id, user_id, ts FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def join_asof(t: Tables):
    orders = t.orders.groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.min("o_orderkey").alias("o_orderkey"))
    return joins.asof(t.events.select("event_id", "user_id", "ts"), orders, ["user_id"], "ts", "o_orderdate", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 5 AND s_acctbal + 5")
def join_range(t: Tables):
    ranges = t.supplier.select("s_suppkey", (F.col("s_acctbal") - 5).alias("lo"), (F.col("s_acctbal") + 5).alias("hi"))
    return joins.point_in_range(t.part.select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "lo", "hi", 10.0).select("p_partkey", "s_suppkey")


@query("""WITH c AS (SELECT c_custkey AS a, c_acctbal AS lo, c_acctbal + 3 AS hi FROM customer), s AS (SELECT s_suppkey AS b, s_acctbal AS lo2, s_acctbal + 20 AS hi2 FROM supplier)
SELECT a, b FROM c JOIN s ON lo <= hi2 AND lo2 <= hi""")
def join_range_overlap(t: Tables):
    a = t.customer.selectExpr("c_custkey AS a", "c_acctbal AS lo", "c_acctbal + 3 AS hi")
    b = t.supplier.selectExpr("s_suppkey AS b", "s_acctbal AS lo2", "s_acctbal + 20 AS hi2")
    return joins.overlapping(a, b, ("lo", "lo2"), ("hi", "hi2"), 20.0).select("a", "b")


@query("SELECT l_returnflag AS f, CAST(count(*) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS w FROM lineitem JOIN (VALUES ('R', 1), ('N', 2), ('A', 3), ('R', 4)) v(f, w) ON l_returnflag = f GROUP BY 1")
def join_skewed_salted(t: Tables):
    weights = t.spark.createDataFrame([("R", 1), ("N", 2), ("A", 3), ("R", 4)], "f string, w int")
    joined = joins.salted(t.lineitem.select(F.col("l_returnflag").alias("f")), weights, ["f"])
    return joined.groupBy("f").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


@query("SELECT a.k AS k FROM (VALUES ('x'), ('y ')) a(k) JOIN (VALUES ('x  '), ('y')) b(k) ON rtrim(a.k) = rtrim(b.k)")
def join_bpchar_keys(t: Tables):
    a, b = t.spark.createDataFrame([("x",), ("y ",)], "k string"), t.spark.createDataFrame([("x  ",), ("y",)], "j string")
    return a.join(b, joins.bpchar_equal(F.col("k"), F.col("j"))).select("k")


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_sort_merge(t: Tables):
    return t.orders.hint("merge").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 150000 GROUP BY 1")
def join_partition_wise(t: Tables):
    """Both sides dealt by the key once; the join and the group reuse that dealing."""
    a = t.orders.where("o_totalprice > 150000").select(F.col("o_orderkey").alias("k")).repartition("k")
    b = t.lineitem.select(F.col("l_orderkey").alias("k")).repartition("k")
    return a.hint("merge").join(b, "k").groupBy(F.col("k").alias("o_orderkey")).agg(F.count("*").alias("n"))
