"""Geometry, network and other types (blueprint 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import geometry as g
from quern.plans.registry import Tables, query


@query("SELECT c_custkey, round(sqrt(pow(c_nationkey - 3, 2) + pow(c_acctbal - 100, 2)), 6) AS d, round(abs(c_nationkey - 3) * abs(c_acctbal - 100), 4) AS a, round(pi() * c_nationkey * c_nationkey, 6) AS ca FROM customer")
def geo_points(t: Tables):
    p, q = g.point(F.col("c_nationkey"), F.col("c_acctbal")), g.point(F.lit(3), F.lit(100))
    return t.customer.select("c_custkey", F.round(g.distance(p, q), 6).alias("d"), F.round(g.box_area(p, q), 4).alias("a"), F.round(g.circle_area(F.col("c_nationkey")), 6).alias("ca"))


@query("SELECT a, n, l, b, s FROM (VALUES (12.0::DOUBLE, 14.0::DOUBLE, 9.0::DOUBLE, true, 0.0::DOUBLE)) v(a, n, l, b, s)")
def geo_paths(t: Tables):
    pts = F.array(*[g.point(F.lit(a), F.lit(b)) for a, b in ((0, 0), (4, 0), (4, 3), (0, 3))])
    at = lambda x, y: g.point(F.lit(x), F.lit(y))
    return t.spark.range(1).select(g.polygon_area(pts).alias("a"), g.path_length(pts, closed=True).alias("n"), (g.path_length(pts) - 2).alias("l"), g.box_contains(at(0, 0), at(4, 3), at(4, 1)).alias("b"), g.slope(at(0, 0), at(4, 0)).alias("s"))


@query("SELECT i, n, m, w, b, s FROM (VALUES ('192.168.1.5/24', 3232235781, '255.255.255.0', '192.168.1.0/24', '192.168.1.255', true), ('10.1.2.3', 167838211, '255.255.255.255', '10.1.2.3/32', '10.1.2.3', false)) v(i, n, m, w, b, s)")
def net_inet(t: Tables):
    rows = t.spark.createDataFrame([("192.168.1.5/24",), ("10.1.2.3",)], "i string")
    i = F.col("i")
    return rows.select("i", g.inet_number(i).alias("n"), g.netmask(i).alias("m"), g.network(i).alias("w"), g.broadcast_address(i).alias("b"), g.subnet_contains(F.lit("192.168.0.0/16"), i).alias("s"))


@query("SELECT m, x FROM (VALUES ('0800.2b01.0203', '08:00:2b:01:02:03'), ('08-00-2B-01-02-03', '08:00:2b:01:02:03')) v(m, x)")
def net_macaddr(t: Tables):
    rows = t.spark.createDataFrame([("0800.2b01.0203",), ("08-00-2B-01-02-03",)], "m string")
    return rows.select("m", g.macaddr(F.col("m")).alias("x"))


@query("SELECT c, v FROM (VALUES ('978-0-306-40615-7', true), ('9780306406158', false)) x(c, v)")
def misc_isbn(t: Tables):
    rows = t.spark.createDataFrame([("978-0-306-40615-7",), ("9780306406158",)], "c string")
    return rows.select("c", g.ean13_valid(F.col("c")).alias("v"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 0 END::BIGINT AS e FROM orders")
def misc_enum_order(t: Tables):
    return t.orders.select("o_orderkey", g.enum_order(F.col("o_orderstatus"), "P", "O", "F").alias("e"))
