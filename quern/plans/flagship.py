"""Benchmark queries: TPC-H shapes over the tables at hand.

Money is summed as decimals: the sums are exact, whatever the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.registry import Tables, portable, query

REVENUE = "CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))"


@query("""
SELECT n_name, CAST(count(*) AS BIGINT) AS n_items, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND r_name <> 'AFRICA'
GROUP BY n_name""")
def flagship_revenue_by_nation(t: Tables):
    orders = t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01'").select("o_orderkey", "o_custkey")
    nations = t.nation.join(t.region.where("r_name <> 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    items = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return items.groupBy("n_name").agg(F.count("*").alias("n_items"), F.sum(F.expr(REVENUE)).cast("double").alias("revenue"))


portable("tpch_q1_pricing_summary", """
SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DOUBLE) AS sum_base,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS sum_disc, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) * (1 + CAST(l_tax AS DECIMAL(4, 2)))) AS DOUBLE) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM {lineitem} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
portable("tpch_q3_shipping_priority", """
SELECT o_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue, o_orderdate
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15'
GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
portable("tpch_q5_local_supplier", """
SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
portable("tpch_q6_forecast_revenue", """
SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(4, 2))) AS DOUBLE) AS revenue FROM {lineitem}
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
portable("tpch_q7_volume_shipping", """
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS INT) AS l_year, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS volume
FROM {supplier} JOIN {lineitem} ON s_suppkey = l_suppkey JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey
JOIN {nation} n1 ON s_nationkey = n1.n_nationkey JOIN {nation} n2 ON c_nationkey = n2.n_nationkey
WHERE n1.n_regionkey = 1 AND n2.n_regionkey = 2 GROUP BY n1.n_name, n2.n_name, extract(year FROM l_shipdate)""")
portable("tpch_q10_returned_items", """
SELECT c_custkey, c_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue, c_acctbal, n_name
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
portable("tpch_q14_promo_effect", """
SELECT round(CAST(100 AS DOUBLE) * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE), 6) AS promo
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""")
portable("tpch_q18_large_orders", """
SELECT c_name, c_custkey, o_orderkey, o_totalprice, CAST(sum(l_quantity) AS DOUBLE) AS qty
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 180)
GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
portable("tpch_q19_disjunctive_filter", """
SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue, count(*) AS n FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE (p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 16 AND 30 AND l_quantity BETWEEN 10 AND 20) OR (p_size > 45 AND l_quantity >= 40)""")
