"""Aggregation (blueprint 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import aggregates as a
from quern.plans.registry import Tables, portable, query

portable("agg_plain_empty", "SELECT count(*) AS n, sum(c_acctbal) AS s, max(c_name) AS m FROM {customer} WHERE c_custkey < 0")
portable("agg_hash", "SELECT l_suppkey, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q, max(l_shipdate) AS last FROM {lineitem} GROUP BY l_suppkey")
portable("agg_expression_keys", "SELECT o_custkey % 10 AS k, CAST(extract(year FROM o_orderdate) AS INT) AS y, count(*) AS n FROM {orders} GROUP BY o_custkey % 10, extract(year FROM o_orderdate)")
portable("agg_group_no_aggregate", "SELECT l_returnflag, l_linestatus FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
portable("agg_select_distinct", "SELECT DISTINCT p_brand, p_size FROM {part} WHERE p_size < 10")
portable("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS gf, CAST(grouping(l_linestatus) AS INT) AS gs FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
portable("agg_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
portable("agg_cube", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS s FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
portable("agg_grouping_mask", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS mask, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
portable("agg_counts", "SELECT count(*) AS a, count(x) AS b, count(DISTINCT x) AS c FROM (VALUES (1), (1), (NULL), (2)) AS v(x)")
portable("agg_min_max_types", "SELECT min(o_orderdate) AS d0, max(o_orderdate) AS d1, min(o_orderpriority) AS p0, max(o_totalprice) AS t1 FROM {orders}")
portable("agg_bool", "SELECT l_returnflag, bool_and(l_quantity > 0) AS a, bool_or(l_quantity > 49) AS o FROM {lineitem} GROUP BY l_returnflag")
portable("agg_bit", "SELECT c_nationkey, bit_and(c_custkey) AS a, bit_or(c_custkey) AS o, bit_xor(c_custkey) AS x FROM {customer} GROUP BY c_nationkey")
portable("agg_any_value", "SELECT n_regionkey, any_value(n_regionkey + 1) AS v FROM {nation} GROUP BY n_regionkey")
portable("agg_variance", "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(stddev_pop(l_quantity), 6) AS sp, round(stddev(l_quantity), 6) AS ss FROM {lineitem} GROUP BY l_returnflag")
portable("agg_regression", "SELECT l_linenumber, round(corr(l_extendedprice, l_quantity), 6) AS c, round(covar_pop(l_extendedprice, l_quantity), 3) AS cp, round(covar_samp(l_extendedprice, l_quantity), 3) AS cs, round(regr_slope(l_extendedprice, l_quantity), 5) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 4) AS ic, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 5) AS ax, round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx FROM {lineitem} GROUP BY l_linenumber")
portable("agg_distinct_several", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS a, count(DISTINCT l_partkey) AS b, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS c FROM {lineitem} GROUP BY l_returnflag")
portable("agg_filter", "SELECT l_suppkey, count(*) FILTER (WHERE l_discount > 0.05) AS n, CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS q FROM {lineitem} GROUP BY l_suppkey")
portable("agg_percentile_cont", "SELECT l_linenumber, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p50, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p90 FROM {lineitem} GROUP BY l_linenumber")
portable("agg_percentile_disc", "SELECT l_linenumber, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_extendedprice) AS q1, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity DESC) AS md FROM {lineitem} GROUP BY l_linenumber")
portable("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 200000")
portable("agg_partial_final_high_cardinality", "SELECT l_orderkey, l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM {lineitem} GROUP BY l_orderkey, l_suppkey")


@query("SELECT count(*) AS n FROM customer WHERE c_custkey < 0")
def agg_empty_grouping_set(t: Tables):
    """GROUPING SETS (()) has one row on empty input: it is the aggregate of the whole."""
    return t.customer.where("c_custkey < 0").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber, CAST(sum(l_orderkey) AS DOUBLE) AS s, round(avg(l_orderkey), 6) AS m FROM lineitem GROUP BY 1")
def agg_sum_exact(t: Tables):
    return t.lineitem.groupBy("l_linenumber").agg(a.sum_exact(F.col("l_orderkey")).cast("double").alias("s"), F.round(F.avg("l_orderkey"), 6).alias("m"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def agg_distinct_on(t: Tables):
    return a.distinct_on(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT n_regionkey, list(CASE WHEN n_nationkey % 2 = 0 THEN n_name END ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def agg_array_agg_nulls(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(a.array_agg(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.col("n_nationkey")).alias("names"))


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def agg_string_agg_ordered(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(a.string_agg(F.col("n_name"), "|", F.col("n_name")).alias("names"))


@query("SELECT n_regionkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS j, '{' || string_agg('\"' || n_nationkey || '\":\"' || n_name || '\"', ',' ORDER BY CAST(n_nationkey AS VARCHAR)) || '}' AS o FROM nation GROUP BY 1")
def agg_json(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(a.json_agg(F.col("n_nationkey"), F.col("n_nationkey")).alias("j"), a.json_object_agg(F.col("n_nationkey"), F.col("n_name")).alias("o"))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_linenumber FROM lineitem) GROUP BY 1")
def agg_distinct_rows(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct(F.struct("l_suppkey", "l_linenumber")).alias("n"))


@query("SELECT l_suppkey, l_linenumber AS m FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def agg_mode(t: Tables):
    return t.lineitem.groupBy("l_suppkey").agg(a.mode(F.col("l_linenumber")).alias("m"))


@query("""SELECT o_orderpriority, CAST(1 + count(*) FILTER (WHERE o_totalprice < 150000) AS BIGINT) AS r, CAST(1 + count(DISTINCT o_totalprice) FILTER (WHERE o_totalprice < 150000) AS BIGINT) AS dr,
round(count(*) FILTER (WHERE o_totalprice < 150000) / count(*), 8) AS pr, round((count(*) FILTER (WHERE o_totalprice <= 150000) + 1) / (count(*) + 1), 8) AS cd FROM orders GROUP BY 1""")
def agg_hypothetical_set(t: Tables):
    x, v = F.col("o_totalprice"), F.lit(150000)
    h = lambda kind: a.hypothetical(kind, x, v)
    return t.orders.groupBy("o_orderpriority").agg(h("rank").alias("r"), h("dense_rank").alias("dr"), F.round(h("percent_rank"), 8).alias("pr"), F.round(h("cume_dist"), 8).alias("cd"))


@query("""SELECT l_suppkey, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT l_suppkey, lo, hi, CASE WHEN max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END AS fresh FROM (
SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS lo, CAST(l_shipdate AS DATE) + 2 AS hi FROM lineitem))) GROUP BY l_suppkey, island""")
def agg_range_agg(t: Tables):
    ranges = t.lineitem.select("l_suppkey", F.col("l_shipdate").cast("date").alias("lo"), F.date_add(F.col("l_shipdate").cast("date"), 2).alias("hi"))
    return a.range_agg(ranges, ["l_suppkey"], "lo", "hi")


@query("SELECT label, CAST(i AS INT) AS i, round(avg(x), 6) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def agg_vector_avg(t: Tables):
    means = a.vector_avg(t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("v")), ["label"], "v")
    return means.select("label", F.posexplode("v").alias("p", "x")).select("label", (F.col("p") + 1).alias("i"), F.round("x", 6).alias("m"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT 1)")
def agg_approx_distinct(t: Tables):
    """Within 5% of the exact count."""
    got = t.lineitem.agg(F.approx_count_distinct("l_orderkey", 0.01).alias("x"), F.count_distinct("l_orderkey").alias("y"))
    return got.where("abs(x - y) <= 0.05 * y").agg(F.count("*").alias("n"))


@query("SELECT label, CAST(i AS INT) AS i, round(sum(x), 5) AS s FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def agg_vector_sum(t: Tables):
    sums = a.vector_avg(t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("v")), ["label"], "v", F.sum)
    return sums.select("label", F.posexplode("v").alias("p", "x")).select("label", (F.col("p") + 1).alias("i"), F.round("x", 5).alias("s"))


@query("SELECT l_orderkey, CASE WHEN lo < hi THEN lo END AS low, CASE WHEN lo < hi THEN hi END AS high FROM (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS lo, min(CAST(l_shipdate AS DATE)) + 30 AS hi FROM lineitem GROUP BY 1)")
def agg_range_intersect(t: Tables):
    day = F.col("l_shipdate").cast("date")
    return t.lineitem.groupBy("l_orderkey").agg(a.range_intersect_agg(day, F.date_add(day, 30)).alias("r")).select("l_orderkey", "r.*")
