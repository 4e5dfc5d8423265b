"""Window functions (blueprint 2.7)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import windows as w
from quern.plans.registry import Tables, portable, query

portable("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM {orders}")
portable("win_rank_dense_rank", "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
portable("win_percent_rank_cume_dist", "SELECT p_partkey, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM {part} WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
portable("win_ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q FROM {customer}")
portable("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS a, lead(o_totalprice, 2, -1.0) OVER w AS b FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
portable("win_first_last_nth", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 3) OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
portable("win_aggregate_running", "SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS DOUBLE) AS s, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {lineitem}")
portable("win_frame_rows", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS m FROM {events}")
portable("win_frame_range_numeric", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS n FROM {part}")
portable("win_frame_range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS n FROM {orders}")
portable("win_frame_unbounded_following", "SELECT l_orderkey, l_linenumber, min(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d FROM {lineitem}")
portable("win_peers_default_frame", "SELECT c_custkey, count(*) OVER (ORDER BY c_nationkey) AS n FROM {customer}")
portable("win_over_aggregate", "SELECT c_nationkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC, c_nationkey) AS BIGINT) AS r FROM {customer} GROUP BY c_nationkey")


@query("SELECT p_partkey, CAST(count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part")
def win_frame_groups(t: Tables):
    return w.groups_frame(t.part, ["p_brand"], [F.col("p_size")], -1, 1, n=F.count("*"), s=F.sum("p_size")).select("p_partkey", "n", "s")


_EX = "OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE {})"


def _exclude(kind: str, sql: str):
    def run(t: Tables):
        rows = t.part.withColumn("k", F.col("p_size") * 100_000 + F.col("p_partkey")) if kind == "current_row" else t.part.groupBy("p_brand", "p_size").agg(F.sum("p_retailprice").alias("p_retailprice"), F.min("p_partkey").alias("p_partkey"))
        # k repeats from part key 100,000 on; the part key makes the order, and so the frames, the same in every run.
        order = [F.col("k"), F.col("p_partkey")] if kind == "current_row" else [F.col("p_size")]
        got = w.exclude(rows, ["p_brand"], order, "p_retailprice", kind, -2, 2, {"s": "sum", "n": "count"})
        return got.select("p_partkey", F.round("s", 4).alias("s"), "n")

    run.__name__ = f"win_exclude_{kind}"
    query(sql)(run)


_exclude("current_row", "SELECT p_partkey, round(sum(p_retailprice) OVER w, 4) AS s, CAST(count(p_retailprice) OVER w AS BIGINT) AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size * 100000 + p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)")
for _kind in ("group", "ties"):
    _exclude(_kind, f"SELECT p_partkey, round(sum(p) OVER w, 4) AS s, CAST(count(p) OVER w AS BIGINT) AS n FROM (SELECT p_brand, p_size, sum(p_retailprice) AS p, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2) WINDOW w AS (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE {_kind.upper()})")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey) - o_totalprice, 3) AS rest FROM orders")
def win_exclude_algebra(t: Tables):
    whole = Window.partitionBy("o_custkey")
    rest, _ = w.exclude_current(F.sum("o_totalprice").over(whole), F.count("o_totalprice").over(whole), F.col("o_totalprice"))
    return t.orders.select("o_orderkey", F.round(F.coalesce(rest, F.lit(0.0)), 3).alias("rest"))


@query("SELECT a.o_orderkey, b.o_orderkey AS prev FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) b ON a.o_custkey = b.o_custkey AND b.r = a.r - (a.o_orderkey % 3)")
def win_lag_expression_offset(t: Tables):
    return w.shift(t.orders, ["o_custkey"], [F.col("o_orderkey")], "o_orderkey", (F.col("o_orderkey") % 3).cast("int"), "prev").select("o_orderkey", "prev")


@query("SELECT o_orderkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS n FROM orders")
def win_aggregate_filter(t: Tables):
    window = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select("o_orderkey", w.filtered_over(F.count, F.lit(1), F.col("o_orderstatus") == "F", window).alias("n"))


@query("SELECT o_orderkey, CAST(n AS BIGINT) AS n FROM orders JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) USING (o_custkey)")
def win_distinct_aggregate(t: Tables):
    return t.orders.select("o_orderkey", w.distinct_over(F.col("o_orderpriority"), Window.partitionBy("o_custkey")).alias("n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM orders) WHERE r <= 2")
def win_top_n_rank(t: Tables):
    return w.top_per_group(t.orders, ["o_custkey"], [F.col("o_orderpriority")], 2).select("o_custkey", "o_orderkey")


@query("""SELECT user_id, CAST(max(session) AS BIGINT) AS sessions, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY 1""")
def win_sessions_gaps_islands(t: Tables):
    marked = w.sessions(t.events.select("user_id", "ts"), ["user_id"], "ts", 6 * 3600)
    return marked.groupBy("user_id").agg(F.max("session").alias("sessions"), F.count("*").alias("n"))


@query("SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS m FROM events")
def win_user_defined(t: Tables):
    @F.pandas_udf("double")
    def median(x: pd.Series) -> float:
        return float(x.median())

    window = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, 0)
    return t.events.select("event_id", F.round(median("value").over(window), 6).alias("m"))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER a, 3) AS a, min(o_totalprice) OVER b AS b, CAST(count(o_totalprice) OVER b AS BIGINT) AS bn, round(avg(o_totalprice) OVER c, 4) AS c, max(o_totalprice) OVER c AS cm FROM orders WINDOW
a AS (PARTITION BY o_orderpriority ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), b AS (PARTITION BY o_orderpriority ORDER BY o_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING EXCLUDE TIES),
c AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)""")
def win_exclude_open_frame(t: Tables):
    """Frames without a bound, in partitions of a fifth of the table."""
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice")
    by, price = ["o_orderpriority"], "o_totalprice"
    rows = w.exclude(rows, by, [F.col("o_custkey")], price, "group", None, 0, {"a": "sum"})
    rows = w.exclude(rows, by, [F.col("o_custkey")], price, "ties", 0, None, {"b": "min", "bn": "count"})
    rows = w.exclude(rows, by, [F.col("o_orderkey")], price, "current_row", None, 2, {"c": "avg", "cm": "max"})
    return rows.select("o_orderkey", F.round("a", 3).alias("a"), "b", "bn", F.round("c", 4).alias("c"), "cm")
