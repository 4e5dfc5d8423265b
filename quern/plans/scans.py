"""Scans and sources (blueprint 2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import scans
from quern.plans.registry import Tables, portable, query
from quern.sources import files

portable("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} WHERE l_quantity < 5 AND l_returnflag = 'R'")
portable("scan_columnar_pruned", "SELECT l_suppkey, count(*) AS n FROM {lineitem} WHERE l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' GROUP BY l_suppkey")
portable("scan_index_range", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey BETWEEN 100 AND 250")
portable("scan_index_only", "SELECT o_orderkey FROM {orders} WHERE o_orderkey > 14000")
portable("scan_index_backward", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 25")
portable("scan_bitmap_and_or", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_partkey = 7 OR l_suppkey = 3) AND (l_quantity > 30 OR l_discount = 0.1)")
portable("scan_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
portable("scan_result_row", "SELECT 1 AS one, 'a' AS a, 2 + 3 AS five")
portable("scan_one_time_false", "SELECT c_custkey FROM {customer} WHERE 1 = 0")
portable("scan_subquery", "SELECT flag, n FROM (SELECT l_returnflag AS flag, count(*) AS n FROM {lineitem} GROUP BY l_returnflag) AS s WHERE n > 10")
portable("scan_cte_shared", """
WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey)
SELECT a.o_custkey, round(a.total, 2) AS total FROM big a WHERE a.total > (SELECT avg(total) FROM big)""")


@query("SELECT o_orderkey, i FROM orders, (SELECT unnest(generate_series(1, 3)) AS i)")
def scan_function_series(t: Tables):
    return t.orders.select("o_orderkey", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("i"))


@query("SELECT event_id, w AS word, CAST(i AS BIGINT) AS ordinality FROM (SELECT event_id, string_split(event_type, 'e') AS a FROM events), LATERAL (SELECT unnest(a) AS w, generate_subscripts(a, 1) AS i)")
def scan_with_ordinality(t: Tables):
    return scans.with_ordinality(t.events.select("event_id", F.split("event_type", "e").alias("a")), F.col("a"), "word").drop("a")


@query("""SELECT r_regionkey, a, b, CAST(o AS BIGINT) AS ordinality FROM (SELECT r_regionkey, unnest(generate_series(1, 4)) AS o FROM region) JOIN LATERAL
(SELECT CASE WHEN o <= 4 THEN o * 10 END AS a, CASE WHEN o <= 2 THEN o + 100 END AS b) ON true""")
def scan_rows_from(t: Tables):
    big = lambda *xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    return scans.rows_from(t.region.select("r_regionkey"), ordinal="ordinality", a=big(10, 20, 30, 40), b=big(101, 102))


@query("""SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 1) AS DOUBLE[])), 6) AS distance
FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 1) AS DOUBLE[])), vec_id LIMIT 15""")
def scan_knn_ordered(t: Tables):
    from quern.functions import vectors

    probe = t.embeddings.where("vec_id = 1").select(F.col("embedding").alias("probe"))
    near = scans.nearest(t.embeddings.join(F.broadcast(probe)), vectors.l2_distance(F.col("embedding"), F.col("probe")), 15, "vec_id")
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


@query()
def scan_sample_bernoulli(t: Tables):
    return scans.sample_bernoulli(t.lineitem, 10, 42, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


@query()
def scan_sample_system(t: Tables):
    return scans.sample_system(t.orders, 25, 42, F.floor(F.col("o_orderkey") / 64)).select("o_orderkey")


@query("SELECT 100 AS n")
def scan_sample_system_rows(t: Tables):
    return scans.sample_rows(t.customer, 100, 7, "c_custkey").agg(F.count("*").cast("int").alias("n"))


@query("SELECT CAST(file_row_number AS BIGINT) AS row_index, r_name FROM (SELECT row_number() OVER () - 1 AS file_row_number, r_name FROM region) WHERE file_row_number BETWEEN 1 AND 3")
def scan_tid_range(t: Tables):
    return scans.row_range(t.region, 1, 3).select("row_index", "r_name")


@query("SELECT page_id, CAST(xp.i AS BIGINT) AS pos, xp.href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS links FROM pages), LATERAL (SELECT unnest(links) AS href, generate_subscripts(links, 1) AS i) xp")
def scan_xmltable_links(t: Tables):
    nav = F.concat(F.regexp_extract("html", r"(?s)(<nav>.*?</nav>)", 1))
    items = scans.with_ordinality(t.pages.select("page_id", nav.alias("x")), F.expr("xpath(x, '//a/@href')"), "href", "pos")
    return items.select("page_id", "pos", "href")


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.page') AS BIGINT) AS page, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def scan_json_table(t: Tables):
    from quern.functions import jsons

    return jsons.json_table(t.events, "props", {"page": ("$.page", "bigint", None), "missing": ("$.missing", "string", "none")}).select("event_id", "page", "missing")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 3")
def scan_foreign_csv(t: Tables):
    """Writes CSV to the shared folder and reads it as a foreign table with a filter."""
    source = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return files.foreign_table(t.spark, files.stage(source, "csv"), "csv", source.schema).where("c_nationkey = 3").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT s_suppkey, s_name FROM supplier")
def scan_foreign_parquet_codecs(t: Tables):
    """The same rows through every Parquet codec at hand."""
    parts = []
    for i, codec in enumerate(("snappy", "gzip", "zstd", "lz4")):
        path = files.stage(t.supplier.where(F.col("s_suppkey") % 4 == i), "parquet", compression=codec)
        parts.append(t.spark.read.schema(t.supplier.schema).parquet(path))
    return scans.union_scans(*parts).select("s_suppkey", "s_name")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name")
def scan_sorted_merge(t: Tables):
    """A table written in sorted runs, read in order."""
    path = files.stage(t.nation.repartition(4, "n_regionkey").sortWithinPartitions("n_name"), "parquet")
    return t.spark.read.schema(t.nation.schema).parquet(path).orderBy("n_name").select("n_nationkey", "n_name")


@query("SELECT part_id, CAST(i AS INT) AS i FROM (SELECT p_partkey AS part_id, unnest(generate_series(1, length(p_brand))) AS i FROM part)")
def scan_generate_subscripts(t: Tables):
    letters = F.split("p_brand", "")
    return t.part.select(F.col("p_partkey").alias("part_id"), F.explode(F.sequence(F.lit(1), F.size(letters))).alias("i"))
