"""Set-returning functions in the target list (blueprint 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import srf
from quern.plans.registry import Tables, query


@query("SELECT n_nationkey, unnest(generate_series(1, n_regionkey)) AS i FROM nation")
def srf_series(t: Tables):
    return srf.project_set(t.nation, ["n_nationkey"], i=srf.series(1, F.col("n_regionkey").cast("bigint")))


@query("SELECT r_regionkey, a, b FROM region, (VALUES (1::BIGINT, 10::BIGINT), (2, 11), (3, NULL)) v(a, b)")
def srf_lock_step(t: Tables):
    return srf.project_set(t.region, ["r_regionkey"], a=srf.series(1, 3), b=srf.series(10, 11))


@query("SELECT DISTINCT unnest(generate_series(1, n_regionkey)) AS i FROM nation")
def srf_under_distinct(t: Tables):
    return srf.project_set(t.nation, ["n_nationkey"], i=srf.series(1, F.col("n_regionkey").cast("bigint"))).select("i").distinct()


@query("SELECT i, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(generate_series(1, n_regionkey)) AS i FROM nation) GROUP BY i")
def srf_under_group(t: Tables):
    return srf.project_set(t.nation, ["n_nationkey"], i=srf.series(1, F.col("n_regionkey").cast("bigint"))).groupBy("i").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, i FROM (SELECT n_nationkey, unnest(generate_series(5, 1, -2)) AS i FROM nation) ORDER BY n_nationkey, i LIMIT 7")
def srf_descending_limit(t: Tables):
    return srf.project_set(t.nation, ["n_nationkey"], i=srf.series(5, 1, -2)).orderBy("n_nationkey", "i").limit(7)


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
def srf_string_to_table(t: Tables):
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))


@query("SELECT p_partkey, unnest(regexp_extract_all(p_type, '[A-Z]+')) AS w FROM part")
def srf_regexp_matches(t: Tables):
    return t.part.select("p_partkey", F.explode(F.regexp_extract_all("p_type", F.lit("[A-Z]+"), F.lit(0))).alias("w"))


@query("SELECT event_id, unnest(json_keys(props)) AS k FROM events")
def srf_json_object_keys(t: Tables):
    return t.events.select("event_id", F.explode(F.json_object_keys("props")).alias("k"))


@query("SELECT p_partkey, unnest(string_split_regex(p_name, '[aeiou]+')) AS part FROM part")
def srf_regexp_split_to_table(t: Tables):
    from quern.operators.srf import regexp_split

    return t.part.select("p_partkey", F.explode(regexp_split(F.col("p_name"), "[aeiou]+")).alias("part"))
