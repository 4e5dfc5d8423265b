"""WARC archives: round trip, revisits, assembly across archives, edges."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from quern.llm import common, warc

SCHEMA = "page_id bigint, url string, html string, record int, digest string, uid string"


def test_round_trip_and_edges(spark):
    same = "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é" * 200
    rows = [(4, "http://a/ b\r\nX: y", same), (2, "http://b", same), (9, None, same), (2, "http://b", same), (5, "u", None), (6, "u", ""), (7, "u", "x" * 99), (8, "u", "x" * 99), (None, "n", same), (11, "long", "abc " * 300_000)]
    pages = spark.createDataFrame([(*r, 1, "d", "u") for r in rows], SCHEMA)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    assert sorted((r.page_id or 0, r.payload_digest) for r in got) == sorted((r[0] or 0, hashlib.sha256((r[2] or "").encode()).hexdigest()) for r in rows)
    assert all(r.payload_bytes == len((dict((x[0], x[2]) for x in rows)[r.page_id] or "").encode()) for r in got)
    kinds = sorted((r.page_id or 0, r.record.type, r.refers_to_page) for r in got if r.payload_digest == hashlib.sha256(same.encode()).hexdigest())
    assert [k[0] for k in kinds] == [0, 2, 2, 4, 9] and sum(k[1] == "response" for k in kinds) == 1
    assert all(k[2] == (2 if k[1] == "revisit" else None) for k in kinds) and ("response" in [k[1] for k in kinds if k[0] == 2])
    assert all(r.record.type == "response" for r in got if r.page_id in (5, 6, 7, 8, 11))
    assert {r.target_uri for r in got if r.page_id in (4, 9)} == {"http://a/%20b%0D%0AX:%20y", None}
    assert all(len(r.request) == len(r.metadata) == 1 for r in got)
    stored = [r for r in got if r.page_id == 2 and r.record.type == "response"]
    assert bytes(stored[0].record.payload) == same.encode()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_assembly_joins_across_archives(spark):
    rows = [("q1", "request", "r1"), ("r1", "response", None), ("m1", "metadata", "r1"), ("m2", "metadata", "r1"), ("r2", "response", None), ("q9", "request", "gone")]
    records = spark.createDataFrame([(i, t, c, None, "u", "d", "dd", 3, None, 3 if t == "response" else None, "dd" if t == "response" else None, 7 if t == "metadata" else None) for i, t, c in rows], warc.RECORDS)
    got = {r.record.record_id: r for r in warc.assemble(records).collect()}
    assert set(got) == {"r1", "r2"} and len(got["r1"].metadata) == 2 and got["r1"].page_id == 7
    assert got["r2"].request == [] and got["r2"].metadata == [] and got["r2"].page_id is None


def test_archives_are_gzip_members_per_record(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i}", 0, "", "") for i in range(20)], SCHEMA)
    folder = common.scratch_path(spark, "warc")
    manifest = warc.write(warc.plan(pages), folder, roll_bytes=2000)
    files = manifest.collect()
    assert len(files) > 2 and sum(r.records for r in files) == 60 + len(files)
    raw = open(files[0].path, "rb").read()
    assert raw.count(b"\x1f\x8b\x08") >= files[0].records
    assert [h["warc-type"] for h, _ in warc.parse(io.BytesIO(gzip.decompress(raw)))][:4] == ["warcinfo", "request", "response", "metadata"]
    assert warc.read(spark, manifest, folder).count() == 60


def test_broken_archives_are_errors():
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"nonsense\r\n")))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def test_each_payload_is_archived_once_whatever_the_rows_come_from(spark):
    base = spark.range(40_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("payload " * 20), (F.col("id") % 5000).cast("string")).alias("html"))
    for pages in (base.repartition(6), base.orderBy(F.md5("html")), base.repartition(7, "html").hint("merge").join(base.select("page_id").repartition(3).hint("merge"), "page_id")):
        got = warc.round_trip(pages, payloads=False)
        r = got.agg(F.count("*").alias("n"), F.count_if(F.col("record.type") == "response").alias("kept"), F.count_if(F.col("refers_to_page").isNotNull()).alias("refer"), F.count_if(F.col("refers_to_page") >= 5000).alias("odd")).first()
        assert (r.n, r.kept, r.refer, r.odd) == (40_000, 5000, 35_000, 0)


def test_file_systems_of_hadoop_folders(tmp_path):
    assert warc.file_system(f"file://{tmp_path}")[1] == str(tmp_path) and warc.file_system(f"file:{tmp_path}")[1] == str(tmp_path)
    assert warc.file_system(str(tmp_path))[1] == str(tmp_path)
    with pytest.raises(ValueError, match="oddfs"):
        warc.file_system("oddfs://x/y")


def test_roles_do_not_depend_on_how_the_payloads_are_met(spark):
    rows = [(1, "a", "x" * 200), (1, "a", "x" * 200), (1, "b", "x" * 200), (None, "a", "x" * 200), (2, "c", "y" * 150), (3, "c", "y" * 150), (4, None, "z" * 101), (5, "e", "short"), (5, "e", "short")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    for most in (200_000, 0):
        got = sorted((r.page_id or 0, r.url or "", r.role) for r in warc.plan(pages, broadcast_rows=most).collect())
        assert got == [(0, "a", "again"), (1, "a", "again"), (1, "a", "first"), (1, "b", "again"), (2, "c", "first"), (3, "c", "again"), (4, "", "own"), (5, "e", "own"), (5, "e", "own")]
