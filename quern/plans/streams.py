"""Streaming windows over events (blueprint 2.13: extensions), run as a batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.plans.registry import Tables, query
from quern.sources import files
from quern.streaming import events


def _stream(t: Tables):
    """The events table as a file stream: the folder listing is the source's."""
    path = files.stage(t.events.select("event_id", "ts", "user_id", "event_type", "value").repartition(4, "event_id"), "parquet")
    return t.spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").option("maxFilesPerTrigger", 2).parquet(path)


def _ntz(*names: str):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2")
def stream_tumbling(t: Tables):
    out = events.tumbling(t.events, "ts", "1 hour", ["event_type"], n=F.count("*"), s=F.round(F.sum("value"), 4))
    return out.select(*_ntz("start"), "event_type", "n", "s")


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_stateful(t: Tables):
    """The same windows by a stateful stream in complete mode."""
    name = f"quern_{uuid.uuid4().hex}"
    stream = events.tumbling(_stream(t), "ts", "1 hour", ["event_type"], delay="30 days", n=F.count("*"))
    return events.run_to_table(stream, name, "complete").select(*_ntz("start"), "event_type", "n")


@query("SELECT s AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1")
def stream_sliding(t: Tables):
    return events.sliding(t.events, "ts", "2 hours", "1 hour", [], n=F.count("*")).select(*_ntz("start"), "n")


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, g""")
def stream_session(t: Tables):
    out = events.session(t.events, "ts", "6 hours", ["user_id"], n=F.count("*"))
    return out.select("user_id", *_ntz("start", "end"), "n")


@query("SELECT s AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1")
def stream_sliding_stateful(t: Tables):
    """The same windows by a stateful stream in complete mode."""
    stream = events.sliding(_stream(t), "ts", "2 hours", "1 hour", [], delay="30 days", n=F.count("*"))
    return events.run_to_table(stream, f"quern_{uuid.uuid4().hex}", "complete").select(*_ntz("start"), "n")


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, g""")
def stream_session_stateful(t: Tables):
    """The same sessions by a stateful stream in complete mode."""
    stream = events.session(_stream(t), "ts", "6 hours", ["user_id"], delay="30 days", n=F.count("*"))
    return events.run_to_files(stream, files.new_path(t.spark, "sessions")).select("user_id", *_ntz("start", "end"), "n")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def stream_view_upkeep(t: Tables):
    """An aggregate view kept by foreachBatch."""
    path, sums = files.new_path(t.spark, "view"), {"n": "1", "total": "value"}
    events.keep_view(_stream(t), path, ["event_type"], sums)
    return events.read_view(t.spark, path, ["event_type"], sums).withColumn("total", F.round("total", 3))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def stream_custom_state(t: Tables):
    """The last row of each key of a stream with custom state."""
    name = f"quern_{uuid.uuid4().hex}"
    got = events.run_to_table(events.running_totals(_stream(t), "event_type", "value"), name, "update")
    return got.groupBy("event_type").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 3).alias("total"))


@query("SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events")
def stream_deduplicate(t: Tables):
    return events.first_of(t.events.select("ts", "user_id"), "ts", ["user_id"]).agg(F.count("*").alias("n"))
