"""Date and time functions (blueprint 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import datetimes as d
from quern.functions import templates
from quern.plans.registry import Tables, portable, query

portable("dt_trunc_group", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, count(*) AS n FROM {orders} GROUP BY date_trunc('month', o_orderdate)", "SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM {orders} GROUP BY 1")
portable("dt_interval_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS a, o_orderdate - INTERVAL '36' HOUR AS b FROM {orders}")
portable("dt_make_date", "SELECT o_orderkey, make_date(CAST(extract(year FROM o_orderdate) AS INT), 2, 1) AS d FROM {orders}")
portable("dt_month_clamp", "SELECT DATE '2024-01-31' + INTERVAL '1' MONTH AS a", "SELECT CAST(DATE '2024-01-31' + INTERVAL '1' MONTH AS DATE) AS a")


@query("SELECT o_orderkey, CAST(dayofweek(o_orderdate) AS INT) AS dow, CAST(isodow(o_orderdate) AS INT) AS isodow, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(weekofyear(o_orderdate) AS INT) AS week, CAST(isoyear(o_orderdate) AS INT) AS isoyear, epoch(o_orderdate) AS ep, CAST(decade(o_orderdate) AS BIGINT) AS dec, CAST(century(o_orderdate) AS BIGINT) AS cen FROM orders")
def dt_extract(t: Tables):
    ts = F.col("o_orderdate")
    return t.orders.select("o_orderkey", *[d.extract(f, ts).alias(n) for f, n in (("dow", "dow"), ("isodow", "isodow"), ("doy", "doy"), ("week", "week"), ("isoyear", "isoyear"), ("epoch", "ep"), ("decade", "dec"), ("century", "cen"))])


@query("SELECT o_orderkey, CAST(date_trunc('decade', o_orderdate) AS TIMESTAMP) AS a, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS b, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS c FROM orders")
def dt_trunc_fields(t: Tables):
    ts = F.col("o_orderdate")
    return t.orders.select("o_orderkey", d.date_trunc("decade", ts).alias("a"), d.date_trunc("week", ts).cast("timestamp_ntz").alias("b"), d.date_trunc("quarter", ts).cast("timestamp_ntz").alias("c"))


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2020-01-01 00:05:00') AS b, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def dt_date_bin(t: Tables):
    origin = F.lit("2020-01-01 00:05:00").cast("timestamp_ntz")
    return t.events.groupBy(d.date_bin(900, F.col("ts"), origin).alias("b")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(datepart('year', a) * 12 + datepart('month', a) AS INT) AS months, CAST(datepart('day', a) AS INT) AS days FROM (SELECT o_orderkey, age(TIMESTAMP '2001-04-10', o_orderdate) AS a FROM orders WHERE extract(day FROM o_orderdate) <= 10)")
def dt_age(t: Tables):
    a = d.age(F.lit("2001-04-10").cast("timestamp_ntz"), F.col("o_orderdate"))
    return t.orders.where("extract(day FROM o_orderdate) <= 10").select("o_orderkey", a.alias("a")).select("o_orderkey", "a.months", "a.days")


@query("SELECT n, months, days, CAST(micros AS BIGINT) AS micros FROM (VALUES (1, 1, 5, 7200000000), (2, -1, 29, 82800000000), (3, 0, 0, 0)) v(n, months, days, micros)")
def dt_justify(t: Tables):
    rows = t.spark.createDataFrame([(1, 0, 33, 50 * 3_600_000_000), (2, 0, 0, -3_600_000_000), (3, 0, 0, 0)], "n int, m int, d int, u bigint")
    return rows.select("n", d.justify_interval(d.interval(F.col("m"), F.col("d"), F.col("u"))).alias("i")).select("n", "i.*")


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days FROM orders")
def dt_date_minus_date(t: Tables):
    return t.orders.select("o_orderkey", d.days_between(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("days"))


@query("SELECT CAST(unnest(generate_series(TIMESTAMP '2024-02-27', TIMESTAMP '2024-03-02', INTERVAL 12 HOUR)) AS TIMESTAMP) AS x")
def dt_generate_series(t: Tables):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.spark.range(1).select(F.explode(d.series(at("2024-02-27"), at("2024-03-02"), "'12' HOUR")).alias("x"))


@query("SELECT event_id, ts + INTERVAL 5 HOUR AS utc FROM events")
def dt_at_time_zone(t: Tables):
    return t.events.select("event_id", d.at_time_zone(F.col("ts"), "-05:00").cast("timestamp_ntz").alias("utc"))


@query("SELECT a, b, lt FROM (VALUES (1, 30, false), (1, 31, true), (2, 59, false)) v(a, b, lt)")
def dt_interval_order(t: Tables):
    rows = t.spark.createDataFrame([(1, 30), (1, 31), (2, 59)], "a int, b int")
    return rows.select("a", "b", (d.interval_order(d.interval(F.col("a"))) < d.interval_order(d.interval(0, F.col("b")))).alias("lt"))


@query("SELECT event_id, make_timestamp(event_id * 86400500000) AS a FROM events")
def dt_to_timestamp_epoch(t: Tables):
    return t.events.select("event_id", templates.from_epoch(F.col("event_id") * 86400.5).alias("a"))


portable("dt_value_functions", "SELECT r_regionkey, now() = current_timestamp() AS a, CAST(current_timestamp() AS DATE) = current_date() AS b, now() > TIMESTAMP '2020-01-01' AS c, current_user() IS NOT NULL AS d, CAST(localtimestamp() AS DATE) = current_date() AS e FROM {region}", "SELECT r_regionkey, now() = current_timestamp AS a, CAST(current_localtimestamp() AS DATE) = CAST(current_timestamp AS DATE) AS b, now() > TIMESTAMPTZ '2020-01-01' AS c, current_user IS NOT NULL AS d, CAST(localtimestamp AS DATE) = CAST(current_timestamp AS DATE) AS e FROM region")


@query("SELECT o_orderkey, isfinite(o_orderdate) AS a, isfinite(o_totalprice / 2) AS b FROM orders")
def dt_isfinite(t: Tables):
    return t.orders.select("o_orderkey", d.isfinite(F.col("o_orderdate")).alias("a"), d.isfinite(F.col("o_totalprice") / 2).alias("b"))


@query("SELECT n_nationkey, TIMESTAMP '2024-01-15 12:30:01.5' + to_days(CAST(n_nationkey AS INT)) - INTERVAL 330 MINUTE AS a FROM nation WHERE n_nationkey < 16")
def dt_make_timestamptz(t: Tables):
    c = F.lit
    at = d.make_timestamptz(c(2024), c(1), (F.col("n_nationkey") + 15).cast("int"), c(12), c(30), c(1.5), "Asia/Kolkata")
    return t.nation.where("n_nationkey < 16").select("n_nationkey", at.cast("timestamp_ntz").alias("a"))
