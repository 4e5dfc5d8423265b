"""Math functions (blueprint 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import numbers as m
from quern.plans.registry import Tables, portable, query

portable("num_abs_sign_floor", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS INT) AS s, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c FROM {customer}")
portable("num_power_roots", "SELECT p_partkey, round(sqrt(p_size), 8) AS r, round(power(p_size, 1.5), 6) AS p, round(exp(p_size / 50.0), 8) AS e, round(ln(p_size), 8) AS l FROM {part}")
portable("num_mod_bits", "SELECT c_custkey, c_custkey % 7 AS m, (0 - c_custkey) % 7 AS nm, c_custkey & 12 AS a, c_custkey | 3 AS o FROM {customer}")
portable("num_trig", "SELECT p_size, round(sin(p_size), 10) AS s, round(cos(p_size), 10) AS c, round(atan2(p_size, 3), 10) AS a, round(degrees(p_size), 8) AS d FROM (SELECT DISTINCT p_size FROM {part}) q")
portable("num_decimal_round", "SELECT CAST(round(CAST(2.5 AS DECIMAL(4, 1)), 0) AS DOUBLE) AS a, CAST(round(CAST(-2.5 AS DECIMAL(4, 1)), 0) AS DOUBLE) AS b, CAST(round(CAST(1.255 AS DECIMAL(6, 3)), 2) AS DOUBLE) AS c")


@query("SELECT l_orderkey, l_linenumber, CAST(l_orderkey // l_linenumber AS BIGINT) AS d FROM lineitem")
def num_integer_division(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", m.int_div(F.col("l_orderkey"), F.col("l_linenumber")).alias("d"))


@query("SELECT x, CAST(round_even(x, 0) AS DOUBLE) AS r, round(log10(x), 8) AS l FROM (VALUES (0.5::DOUBLE), (1.5), (2.5), (100.0)) v(x)")
def num_float_rounding_log(t: Tables):
    rows = t.spark.createDataFrame([(0.5,), (1.5,), (2.5,), (100.0,)], "x double")
    return rows.select("x", m.round_half_even(F.col("x")).alias("r"), F.round(m.log10(F.col("x")), 8).alias("l"))


@query("SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l FROM part")
def num_gcd_lcm(t: Tables):
    return t.part.select("p_partkey", m.gcd(F.col("p_partkey"), F.col("p_size")).alias("g"), m.lcm(F.col("p_partkey"), F.col("p_size")).alias("l"))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 2000 THEN 11 ELSE CAST(floor((p_retailprice - 900) / 110.0) AS BIGINT) + 1 END AS b FROM part")
def num_width_bucket(t: Tables):
    return t.part.select("p_partkey", F.width_bucket("p_retailprice", F.lit(900.0), F.lit(2000.0), F.lit(10)).alias("b"))


@query("SELECT d, s, c FROM (VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE), (30, 0.5, round(cos(radians(30)), 12)), (90, 1.0, 0.0), (180, 0.0, -1.0), (240, round(sin(radians(240)), 12), -0.5)) v(d, s, c)")
def num_degrees_exact(t: Tables):
    rows = t.spark.createDataFrame([(0,), (30,), (90,), (180,), (240,)], "d int")
    return rows.select("d", F.round(m.sind(F.col("d")), 12).alias("s"), F.round(m.cosd(F.col("d")), 12).alias("c"))


@query("SELECT a, b, CAST((a IS NULL)::INT + (b IS NULL)::INT AS INT) AS n FROM (VALUES (1, NULL), (NULL, NULL), (2, 3)) v(a, b)")
def num_nulls(t: Tables):
    rows = t.spark.createDataFrame([(1, None), (None, None), (2, 3)], "a int, b int")
    return rows.select("a", "b", m.num_nulls(F.col("a"), F.col("b")).alias("n"))


@query("SELECT CAST(n AS BIGINT) AS n, s FROM (VALUES (500, '500 bytes'), (10239, '10239 bytes'), (10240, '10 kB'), (52428800, '50 MB')) v(n, s)")
def num_size_pretty(t: Tables):
    return t.spark.createDataFrame([(500,), (10239,), (10240,), (52428800,)], "n bigint").select("n", m.size_pretty(F.col("n")).alias("s"))


@query("SELECT t, s, k FROM (VALUES ('1.5', '1.5', 3), ('2', '2', 3)) v(t, s, k)")
def num_scale_trim(t: Tables):
    rows = t.spark.createDataFrame([("1.500",), ("2.000",)], "x string").select(F.col("x").cast("decimal(10,3)").alias("x"))
    return rows.select(m.trim_scale(F.col("x")).alias("t"), m.trim_scale(F.col("x")).alias("s"), m.scale(F.col("x")).alias("k"))


@query("SELECT CAST(1000 AS BIGINT) AS n, true AS inside")
def num_random(t: Tables):
    return t.spark.range(1000).select(F.rand(3).alias("r")).agg(F.count("*").alias("n"), F.bool_and((F.col("r") >= 0) & (F.col("r") < 1)).alias("inside"))


@query("SELECT CAST(x AS DOUBLE) AS x, CAST(count(*) AS BIGINT) AS n FROM (VALUES ('NaN'::DOUBLE), ('NaN'::DOUBLE), (0.0), (-0.0)) v(x) GROUP BY x + 0.0, x")
def num_nan_grouping(t: Tables):
    rows = t.spark.createDataFrame([(float("nan"),), (float("nan"),), (0.0,), (-0.0,)], "x double")
    return rows.groupBy("x").agg(F.count("*").alias("n"))


@query("SELECT CAST(200000 AS BIGINT) AS n, true AS mean, true AS deviation, true AS within")
def num_normal_rand(t: Tables):
    """Moments of a seeded sample: the mean within 0.05 of 10, the deviation of 2, 68% within one deviation."""
    x = m.normal_rand(t.spark, 200_000, 10.0, 2.0, seed=1).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev("x").alias("s"), F.avg((F.abs(F.col("x") - 10) <= 2).cast("int")).alias("w"))
    return x.select("n", (F.abs(F.col("m") - 10) < 0.05).alias("mean"), (F.abs(F.col("s") - 2) < 0.05).alias("deviation"), (F.abs(F.col("w") - 0.6827) < 0.01).alias("within"))
