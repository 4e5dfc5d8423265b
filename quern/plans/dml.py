"""Sinks, DML and commands (blueprint 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import checks, dml
from quern.plans.registry import Tables, portable, query
from quern.sources import files


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100 + r_regionkey, upper(r_name), 9 FROM region")
def dml_insert_select(t: Tables):
    given = t.region.select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.upper("r_name").alias("n_name"))
    return dml.insert(t.nation, given, {"n_regionkey": F.lit(9)})[0]


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def dml_on_conflict_do_nothing(t: Tables):
    return dml.upsert(t.region, t.nation.selectExpr("n_nationkey AS r_regionkey", "n_name AS r_name"), ["r_regionkey"])[0]


@query("""SELECT coalesce(r.r_regionkey, n.n_nationkey) AS r_regionkey, CASE WHEN r.r_regionkey IS NULL THEN n.n_name WHEN n.n_nationkey IS NULL THEN r.r_name ELSE r.r_name || '/' || n.n_name END AS r_name
FROM region r FULL JOIN nation n ON r.r_regionkey = n.n_nationkey""")
def dml_on_conflict_do_update(t: Tables):
    given = t.nation.selectExpr("n_nationkey AS r_regionkey", "n_name AS r_name")
    return dml.upsert(t.region, given, ["r_regionkey"], lambda: {"r_name": F.concat_ws("/", F.col("t.r_name"), F.col("s.r_name"))})[0]


@query("""SELECT c_custkey, round(c_acctbal + coalesce(total, 0) / 100, 4) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def dml_update_from(t: Tables):
    totals = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    after, _ = dml.update_from(t.customer, totals, ["c_custkey"], {"c_acctbal": F.col("t.c_acctbal") + F.col("s.total") / 100})
    return after.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def dml_update_where(t: Tables):
    return dml.update(t.orders, F.col("o_totalprice") > 300000, {"o_orderstatus": F.lit("X")})[0].select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def dml_delete_using(t: Tables):
    return dml.delete_using(t.customer, t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])[0].select("c_custkey", "c_name")


MERGE_ORACLE = """
SELECT coalesce(t.p_partkey, s.p_partkey) AS p_partkey, CASE WHEN t.p_partkey IS NULL THEN s.p_size WHEN s.p_partkey IS NOT NULL THEN t.p_size + s.p_size ELSE t.p_size END AS p_size
FROM part t FULL JOIN (SELECT p_partkey + 50 AS p_partkey, p_size FROM part) s ON t.p_partkey = s.p_partkey
WHERE NOT (t.p_partkey IS NOT NULL AND s.p_partkey IS NULL AND t.p_size > 40) AND NOT (t.p_partkey IS NOT NULL AND s.p_partkey IS NOT NULL AND s.p_size < 5)
"""


def _merge(t: Tables):
    source = t.part.select((F.col("p_partkey") + 50).alias("p_partkey"), "p_size")
    return dml.merge(
        t.part.select("p_partkey", "p_size"), source, ["p_partkey"],
        [
            dml.When("matched", "delete", condition=F.col("s.p_size") < 5),
            dml.When("matched", "update", {"p_size": F.col("t.p_size") + F.col("s.p_size")}),
            dml.When("not_matched", "insert", {"p_partkey": F.col("s.p_partkey"), "p_size": F.col("s.p_size")}),
            dml.When("not_matched_by_source", "delete", condition=F.col("t.p_size") > 40),
        ],
    )


@query(MERGE_ORACLE)
def dml_merge(t: Tables):
    return _merge(t)[0]


@query("""SELECT action, CAST(count(*) AS BIGINT) AS n, CAST(sum(old_size) AS BIGINT) AS old_size, CAST(sum(new_size) AS BIGINT) AS new_size FROM (
SELECT t.p_size AS old_size, CASE WHEN t.p_partkey IS NULL THEN 'INSERT' WHEN s.p_partkey IS NULL AND t.p_size > 40 THEN 'DELETE' WHEN s.p_partkey IS NULL THEN NULL WHEN s.p_size < 5 THEN 'DELETE' ELSE 'UPDATE' END AS action,
CASE WHEN t.p_partkey IS NULL THEN s.p_size WHEN s.p_partkey IS NOT NULL AND s.p_size >= 5 THEN t.p_size + s.p_size END AS new_size
FROM part t FULL JOIN (SELECT p_partkey + 50 AS p_partkey, p_size FROM part) s ON t.p_partkey = s.p_partkey) WHERE action IS NOT NULL GROUP BY action""")
def dml_merge_returning(t: Tables):
    changed = _merge(t)[1]
    return changed.groupBy("action").agg(F.count("*").alias("n"), F.sum("old.p_size").alias("old_size"), F.sum("new.p_size").alias("new_size"))


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def dml_data_modifying_cte(t: Tables):
    """WITH gone AS (DELETE ... RETURNING *) SELECT ... FROM gone."""
    _, gone = dml.delete(t.orders, F.col("o_orderstatus") == "F")
    return gone.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def dml_create_table_as(t: Tables):
    path = files.stage(t.lineitem.where("l_quantity > 25").select("l_returnflag", "l_quantity"), "parquet", partition_by=["l_returnflag"])
    return t.spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0")
def dml_copy_round_trip(t: Tables):
    rows = t.customer.where("c_acctbal < 0").select("c_custkey", "c_name", "c_acctbal")
    path = files.new_path(t.spark, "copy")
    files.copy_to(rows, path, "text")
    return files.copy_from(t.spark, path, rows.schema, "text")


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def dml_materialized_view_refresh(t: Tables):
    """REFRESH recomputes the whole view into a new version that replaces the old."""
    defined = lambda: t.orders.where("o_totalprice > 1000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    versions = [files.stage(defined(), "parquet") for _ in range(2)]
    return t.spark.read.parquet(versions[-1])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def dml_view_expansion(t: Tables):
    t.orders.where("o_orderstatus = 'O'").createOrReplaceTempView("quern_small_customers")
    return t.spark.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM quern_small_customers WHERE o_totalprice > 100000")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 2) AND c_acctbal > 0")
def dml_row_level_security(t: Tables):
    return checks.with_policy(t.customer, F.col("c_nationkey").isin(1, 2)).where("c_acctbal > 0").select("c_custkey", "c_name")


@query("SELECT 'unique' AS rule, CAST((SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)) AS BIGINT) AS broken UNION ALL SELECT 'foreign', CAST((SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)) AS BIGINT)")
def dml_constraints(t: Tables):
    unique = checks.duplicates(t.lineitem, ["l_orderkey"]).agg(F.lit("unique").alias("rule"), F.count("*").alias("broken"))
    foreign = checks.orphans(t.orders, t.customer.where("c_custkey % 7 <> 0"), [("o_custkey", "c_custkey")]).agg(F.lit("foreign").alias("rule"), F.count("*").alias("broken"))
    return unique.unionAll(foreign)


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) + 999 AS BIGINT) AS id FROM customer")
def dml_identity_sequence(t: Tables):
    return checks.number_rows(t.customer.select("c_custkey"), "id", ["c_custkey"], start=1000)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 50000")
def dml_prepared_statement(t: Tables):
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = :c AND o_totalprice > :p", args={"c": 7, "p": 50000}, orders=t.orders)


portable("dml_select_for_update", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus = 'P'")


@query("SELECT k, lo FROM (VALUES (1, 4)) v(k, lo)")
def dml_without_overlaps(t: Tables):
    rows = t.spark.createDataFrame([(1, 1, 5), (1, 4, 6), (1, 6, 9), (2, 1, 9)], "k int, lo int, hi int")
    return checks.period_conflicts(rows, ["k"], "lo", "hi").select("k", "lo")
