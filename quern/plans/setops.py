"""Set operations (blueprint 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.registry import Tables, portable, query
from quern.sources import files

portable("set_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
portable("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
portable("set_intersect", "SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey FROM {customer} WHERE c_nationkey < 5")
portable("set_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
portable("set_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000")
portable("set_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
portable("set_nested", "(SELECT n_nationkey AS k FROM {nation} UNION SELECT r_regionkey + 20 FROM {region}) EXCEPT (SELECT c_nationkey FROM {customer} WHERE c_nationkey < 12 INTERSECT SELECT s_nationkey FROM {supplier})")
portable("set_nulls_equal", "SELECT a FROM (VALUES (1), (NULL)) AS v(a) INTERSECT SELECT b FROM (VALUES (NULL), (2)) AS w(b)")


@query("SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(count(*) AS BIGINT) AS n FROM orders WHERE extract(year FROM o_orderdate) IN (1995, 1996) GROUP BY 1")
def set_partition_append_pruned(t: Tables):
    """A table in partitions by year; the filter reads two of them."""
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"))
    path = files.stage(rows, "parquet", partition_by=["y"])
    return t.spark.read.schema("o_orderkey bigint, y int").parquet(path).where("y IN (1995, 1996)").groupBy("y").agg(F.count("*").alias("n"))


@query("SELECT r_name AS name, CAST(NULL AS BIGINT) AS k FROM region UNION ALL SELECT s_name, s_suppkey FROM supplier")
def set_union_by_name(t: Tables):
    return t.region.select(F.col("r_name").alias("name")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), allowMissingColumns=True)
