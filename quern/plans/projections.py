"""Projections, filters and predicates (blueprint 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import predicates as p
from quern.plans.registry import Tables, portable, query

portable("proj_junk_sort_column", "SELECT c_name FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
portable("proj_having_without_group", "SELECT count(*) AS n FROM {orders} HAVING count(*) > 5")
portable("proj_three_valued_logic", "SELECT a, b, a AND b AS x, a OR b AS y, NOT a AS z FROM (VALUES (true, true), (true, false), (true, NULL), (false, true), (false, false), (false, NULL), (NULL, true), (NULL, false), (NULL, NULL)) AS v(a, b)")
portable("proj_is_distinct_from", "SELECT a, b, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS e FROM (VALUES (1, 1), (1, 2), (1, NULL), (NULL, NULL)) AS v(a, b)")
portable("proj_nullif_coalesce", "SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS f, coalesce(nullif(l_discount, 0.0), -1.0) AS d FROM {lineitem}")
portable("proj_greatest_least", "SELECT a, b, greatest(a, b) AS g, least(a, b) AS l FROM (VALUES (1, 2), (5, NULL), (NULL, 7), (NULL, NULL)) AS v(a, b)")
portable("proj_case_searched_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS s, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS b FROM {orders}")
portable("proj_in_list_nulls", "SELECT a, a IN (1, 2) AS x, a IN (1, NULL) AS y, a NOT IN (1, NULL) AS z FROM (VALUES (1), (3), (NULL)) AS v(a)")
portable("proj_null_and_boolean_tests", "SELECT a, a IS NULL AS n, a IS TRUE AS t, a IS NOT FALSE AS f FROM (VALUES (true), (false), (NULL)) AS v(a)", "SELECT a, a IS NULL AS n, coalesce(a, false) AS t, coalesce(a, true) AS f FROM (VALUES (true), (false), (NULL)) AS v(a)")
portable("proj_casts", "SELECT CAST('12' AS INT) AS i, CAST(3.7 AS DOUBLE) AS d, CAST(7 AS STRING) AS s, try_cast('x' AS INT) AS bad, CAST('1999-02-28' AS DATE) AS dt")
portable("proj_like_escape", "SELECT p_partkey, p_name LIKE '%re%' AS a, p_name LIKE 'P_r%' AS b, p_brand LIKE 'Brand#_1' AS c, p_type NOT LIKE '%A%' AS d FROM {part}")
portable("proj_collation_binary", "SELECT p_brand FROM {part} WHERE p_brand < 'Brand#3' AND lower(p_brand) = 'brand#12'")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def proj_between_symmetric(t: Tables):
    return t.lineitem.where(p.between_symmetric(F.col("l_quantity"), F.lit(20), F.lit(10))).select("l_orderkey", "l_linenumber")


@query("SELECT a, b, CASE WHEN len(b) = 0 THEN false WHEN a IS NULL THEN NULL WHEN list_contains(b, a) THEN true WHEN len(list_filter(b, lambda x: x IS NULL)) > 0 THEN NULL ELSE false END AS eq_any, a > list_max(b) AS gt_all FROM (VALUES (1, [1, 2]), (3, [1, NULL]), (NULL, [1]), (2, [1, 1])) v(a, b) WHERE NOT list_contains(b, NULL) OR true")
def proj_any_all_array(t: Tables):
    rows = t.spark.createDataFrame([(1, [1, 2]), (3, [1, None]), (None, [1]), (2, [1, 1])], "a int, b array<int>")
    return rows.select("a", "b", p.eq_any(F.col("a"), F.col("b")).alias("eq_any"), (F.col("a") > F.array_max("b")).alias("gt_all"))


@query("SELECT p_partkey, regexp_full_match(p_brand, 'Brand#(1|2)[0-9]') AS similar, regexp_matches(p_type, '(?i)steel') AS ci, NOT regexp_matches(p_name, '^[a-m]') AS neg, p_name ILIKE '%PART%' AS il FROM part")
def proj_similar_to_regex(t: Tables):
    return t.part.select("p_partkey", p.similar_to(F.col("p_brand"), "Brand#(1|2)[0-9]").alias("similar"), p.matches(F.col("p_type"), "steel", insensitive=True).alias("ci"), (~p.matches(F.col("p_name"), "^[a-m]")).alias("neg"), F.col("p_name").ilike("%PART%").alias("il"))


@query("SELECT a, b, CASE WHEN a <> 2 THEN a < 2 WHEN a IS NULL THEN NULL WHEN b IS NULL THEN NULL ELSE b < 5 END AS lt FROM (VALUES (1, NULL), (2, 4), (2, 5), (2, NULL), (3, 1), (NULL, 1)) v(a, b)")
def proj_row_compare(t: Tables):
    rows = t.spark.createDataFrame([(1, None), (2, 4), (2, 5), (2, None), (3, 1), (None, 1)], "a int, b int")
    return rows.select("a", "b", p.row_less([F.col("a"), F.col("b")], [F.lit(2), F.lit(5)]).alias("lt"))


@query("SELECT a, a[2] AS second, a[2:3] AS part, a[9] AS none FROM (VALUES ([10, 20, 30]), ([1])) v(a)")
def proj_subscript_slice(t: Tables):
    rows = t.spark.createDataFrame([([10, 20, 30],), ([1],)], "a array<int>")
    return rows.select("a", p.subscript(F.col("a"), F.lit(2)).alias("second"), p.array_slice(F.col("a"), 2, 3).alias("part"), p.subscript(F.col("a"), F.lit(9)).alias("none"))


@query("SELECT c_custkey, c_name, c_acctbal * 2 AS bal FROM customer")
def proj_composite_fields(t: Tables):
    row = t.customer.select("c_custkey", F.struct("c_name", "c_acctbal").alias("r"))
    return row.withColumn("r", F.col("r").withField("c_acctbal", F.col("r.c_acctbal") * 2)).select("c_custkey", "r.c_name", F.col("r.c_acctbal").alias("bal"))


@query("SELECT n, o FROM (VALUES (1, true), (2, false), (3, true)) v(n, o)")
def proj_overlaps(t: Tables):
    rows = t.spark.createDataFrame([(1, "2001-02-16", "2001-12-21", "2001-10-30", "2002-10-30"), (2, "2001-02-16", "2001-03-01", "2001-03-01", "2001-04-01"), (3, "2001-12-21", "2001-02-16", "2001-03-01", "2001-04-01")], "n int, a string, b string, c string, d string")
    d = {c: F.col(c).cast("date") for c in "abcd"}
    return rows.select("n", p.overlaps(d["a"], d["b"], d["c"], d["d"]).alias("o"))


@query("SELECT k FROM (VALUES ('a'), ('A')) v(k) WHERE lower(k) = 'a'")
def proj_collation_case_insensitive(t: Tables):
    rows = t.spark.createDataFrame([("a",), ("A",), ("b",)], "k string")
    return rows.where(F.col("k").eqNullSafe("a") | (F.collate("k", "UTF8_LCASE") == F.lit("A"))).select("k")
