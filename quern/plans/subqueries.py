"""Subqueries and CTEs (blueprint 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import recursive
from quern.plans.registry import Tables, portable, query

portable("subq_scalar_init", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")
portable("subq_correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS best FROM {customer}")
portable("subq_correlated_filter", "SELECT l_orderkey, l_linenumber FROM {lineitem} l WHERE l_quantity > (SELECT 1.4 * avg(l_quantity) FROM {lineitem} m WHERE m.l_partkey = l.l_partkey)")
portable("subq_exists_value", "SELECT c_custkey, EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has FROM {customer}")
portable("subq_not_exists", "SELECT s_suppkey FROM {supplier} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.095)")
portable("subq_in", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_discount = 0.1)")
portable("subq_not_in", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)")
portable("subq_not_in_null", "SELECT a FROM (VALUES (1), (2), (NULL)) AS v(a) WHERE a NOT IN (SELECT b FROM (VALUES (1), (NULL)) AS w(b))")
portable("subq_in_empty_set", "SELECT a, a IN (SELECT r_regionkey FROM {region} WHERE r_regionkey > 99) AS x FROM (VALUES (1), (NULL)) AS v(a)")
portable("cte_inline_twice", "WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT a.k AS a, a.n AS n, b.n AS m FROM t a JOIN t b ON a.k + 1 = b.k")
portable("cte_recursive_union_all", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t")
portable("cte_recursive_fibonacci", "WITH RECURSIVE f(i, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 40) SELECT i, a FROM f")


@query("SELECT p_partkey FROM part WHERE p_size > ALL (SELECT p_size FROM part WHERE p_brand = 'Brand#11' AND p_size < 40)")
def subq_quantified_all(t: Tables):
    """x > ALL (q): no q that is null or at least x."""
    q = t.part.where("p_brand = 'Brand#11' AND p_size < 40").select(F.col("p_size").alias("q"))
    return t.part.join(q, F.col("q").isNull() | F.col("p_size").isNull() | (F.col("p_size") <= F.col("q")), "left_anti").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size < ANY (SELECT p_size FROM part WHERE p_brand = 'Brand#11' AND p_size < 4)")
def subq_quantified_any(t: Tables):
    """x < ANY (q) is x < max(q): one number instead of a join."""
    most = t.part.where("p_brand = 'Brand#11' AND p_size < 4").agg(F.max("p_size").alias("q"))
    return t.part.join(F.broadcast(most), F.col("p_size") < F.col("q")).select("p_partkey")


@query("SELECT r_name, list_sort((SELECT list(n_name) FROM nation WHERE n_regionkey = r_regionkey)) AS nations FROM region")
def subq_array(t: Tables):
    lists = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    return t.region.join(lists, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("r_name", F.coalesce("nations", F.array().cast("array<string>")).alias("nations"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) FROM nation)")
def subq_limit(t: Tables):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(t.nation.count())


@query("WITH RECURSIVE r(n) AS (SELECT CAST(1 AS BIGINT) UNION SELECT (n * 7) % 100 FROM r) SELECT n FROM r")
def cte_recursive_union_distinct(t: Tables):
    base = t.spark.range(1, 2).select(F.col("id").alias("n"))
    return recursive.union_distinct(base, lambda last: last.select((F.col("n") * 7 % 100).alias("n")))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey // 3 AS parent, n_nationkey AS child FROM nation WHERE n_nationkey > 0),
w(child, depth, path) AS (SELECT 0, 0, [0] UNION ALL SELECT e.child, depth + 1, list_append(path, e.child) FROM w JOIN e ON w.child = e.parent)
SELECT child, depth, array_to_string(path, '.') AS path FROM w""")
def cte_search_depth_first(t: Tables):
    edges = t.nation.where("n_nationkey > 0").selectExpr("CAST(n_nationkey DIV 3 AS INT) AS parent", "n_nationkey AS child")
    roots = t.nation.where("n_nationkey = 0").select(F.col("n_nationkey").alias("child"))
    found = recursive.traverse(edges, roots, "parent", "child")
    return found.orderBy("path").select("child", "depth", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


@query("SELECT child, depth, is_cycle FROM (VALUES (1, 0, false), (2, 1, false), (3, 2, false), (1, 3, true), (4, 2, false)) v(child, depth, is_cycle)")
def cte_cycle(t: Tables):
    edges = t.spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4)], "parent int, child int")
    roots = t.spark.createDataFrame([(1,)], "child int")
    return recursive.traverse(edges, roots, "parent", "child").select("child", "depth", "is_cycle")


portable("cte_recursive_mandelbrot", """
WITH RECURSIVE x(i) AS (SELECT 0 UNION ALL SELECT i + 1 FROM x WHERE i < 30),
z(ix, iy, cx, cy, zx, zy, i) AS (
  SELECT a.i, b.i, CAST(-2.2 + 0.1 * a.i AS DOUBLE), CAST(-1.5 + 0.1 * b.i AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 0 FROM x a CROSS JOIN x b
  UNION ALL SELECT ix, iy, cx, cy, zx * zx - zy * zy + cx, 2 * zx * zy + cy, i + 1 FROM z WHERE zx * zx + zy * zy < 16 AND i < 12)
SELECT iy, CAST(sum(last) AS BIGINT) AS row_sum FROM (SELECT ix, iy, max(i) AS last FROM z GROUP BY ix, iy) q GROUP BY iy""")
