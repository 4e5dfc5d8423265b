"""WARC archives: writing with revisits, reading back, and assembling captures."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

#: Payloads under this many bytes are always stored.
REVISIT_LEAST = 100
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, declared_digest string, declared_bytes bigint, payload binary, payload_bytes bigint, payload_digest string, page_id bigint"
_NAMES = [f.split()[0] for f in RECORDS.split(", ")]


def plan(pages: DataFrame, least: int = REVISIT_LEAST, broadcast_rows: int = 200_000) -> DataFrame:
    """page_id, url, html, digest, bytes and role of every row: `own`, a response that nothing refers to; `first`,
    the one response of a payload that several rows have; `again`, a revisit of it (html may be null).

    A role follows from the row's own values and from a table in the shared folder of the payloads that
    occur more than once, so it is the same in every task that runs again, whatever pages come from. That table
    is broadcast where it has at most broadcast_rows rows (some 150 bytes each), else met by shuffling.
    Where rows equal to the first are repeated, one of them is taken for it, and the others are made from their number.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.select("*", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("bigint").alias("bytes"))
    alike = keyed.where(F.col("bytes") >= least).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"), F.min("bytes").alias("bytes"))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    by_digest = alike.groupBy("digest").agg(F.min_by(F.struct("page_id", "url", "n", "bytes"), order).alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    repeated = common.cut(by_digest, "warc-repeated")
    few = repeated.count() <= broadcast_rows
    joined = keyed.join(F.broadcast(repeated) if few else repeated.hint("merge"), "digest", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    role = F.when(F.col("first").isNull(), "own").when(~is_first, "again").when(F.col("first.n") == 1, "first").otherwise("one of several")
    planned = joined.select("page_id", "url", "html", "digest", "bytes", role.alias("role"))
    several = repeated.where("first.n > 1")
    if several.isEmpty():
        return planned
    one = planned.where("role = 'one of several'").dropDuplicates(["digest"]).withColumn("role", F.lit("first"))
    number = F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("first.n")))
    others = several.select("first.page_id", "first.url", F.lit(None).cast("string").alias("html"), "digest", "first.bytes", F.lit("again").alias("role"), number.alias("number")).drop("number")
    return planned.where("role <> 'one of several'").unionByName(one).unionByName(others)


def _record(kind: str, record_id: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _urn(name: str | None = None) -> str:
    """A record's id: of a name, always the same, else a new one."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(name.encode()).digest(), version=4) if name else uuid.uuid4()}"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder as Hadoop writes it, and the path there: local, HDFS, S3, Google and Azure stores.
    Another scheme is an error that names it."""
    scheme, mark, rest = folder.partition("://")
    known = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss", "s3": "s3", "file": "file"}
    if not mark:
        folder = folder.removeprefix("file:")
        return pafs.LocalFileSystem(), folder
    if scheme not in known:
        raise ValueError(f"archives can't be written to {scheme}://; known: {', '.join(known)}")
    return pafs.FileSystem.from_uri(f"{known[scheme]}://{rest}")


def write(planned: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = 64 << 20) -> DataFrame:
    """Writes a request, a response or revisit, and a metadata record per row of plan(), one gzip member
    each, and returns the manifest (path, records, bytes) of the archives.

    Every task attempt writes files of its own name, and only attempts that Spark commits reach the
    manifest; files of a lost executor are left out. One archive is open at a time and rolls over.
    """
    spark = planned.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        context = TaskContext.get()
        stem = f"{top}/{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done: list[tuple[str, int, int]] = []
        out, records, size = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{stem}-{len(done):04d}.warc.gz"
                    out = fs.open_output_stream(path, compression=None)
                    info = _record("warcinfo", _urn(), date, [("Content-Type", "application/warc-fields")], b"software: quern\r\nformat: WARC File Format 1.1\r\n")
                    out.write(info)
                    records, size = 1, len(info)
                for piece in _transaction(row, date):
                    out.write(piece)
                    records, size = records + 1, size + len(piece)
                if size >= roll_bytes:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return common.cut(planned.select("page_id", "url", "html", "digest", "bytes", "role").mapInArrow(run, MANIFEST), "warc-manifest")


def _transaction(row: dict, date: str) -> Iterator[bytes]:
    role = row["role"]
    payload = b"" if role == "again" else row["html"].encode("utf-8", "surrogatepass")
    stored = _urn("payload " + row["digest"])
    answer = stored if role == "first" else _urn()
    uri = None if row["url"] is None else _CONTROL.sub(lambda m: quote(m[0]), row["url"])
    about = [] if uri is None else [("WARC-Target-URI", uri)]
    yield _record("request", _urn(), date, [*about, ("WARC-Concurrent-To", f"<{answer}>"), ("Content-Type", "application/http; msgtype=request")], f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    fields = [*about, ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http; msgtype=response")]
    if role != "again":
        yield _record("response", answer, date, fields, http + payload)
    else:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{stored}>")]
        yield _record("revisit", answer, date, fields, http)
    own = b"" if row["page_id"] is None else b"page-id: %d\r\n" % row["page_id"]
    yield _record("metadata", _urn(), date, [*about, ("WARC-Concurrent-To", f"<{answer}>"), ("Content-Type", "application/warc-fields")], own)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {"_version": line.strip().decode()}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"record {head.get('warc-record-id')} ends early")
        yield head, block


def _fields(head: dict[str, str], block: bytes) -> tuple | None:
    kind = head.get("warc-type")
    bare = lambda name: head[name].strip("<>") if name in head else None
    payload = size = digest = declared = page_id = None
    if kind in ("response", "revisit"):
        http, _, body = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                declared = int(value)
        if kind == "response":
            payload, size, digest = body, len(body), hashlib.sha256(body).hexdigest()
    elif kind == "metadata":
        for line in block.split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name == b"page-id":
                page_id = int(value)
    elif kind != "request":
        return None
    said = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if digest is not None and said is not None and said != digest:
        raise ValueError(f"record {bare('warc-record-id')}: payload digest differs")
    return bare("warc-record-id"), kind, bare("warc-concurrent-to"), bare("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), said, declared, payload, size, digest, page_id


def read(spark: SparkSession, manifest: DataFrame, folder: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per request, response, revisit and metadata record of the manifest's archives.

    Each archive is read as a stream; rows leave in batches of about batch_bytes.
    """
    from pyspark.sql.types import _parse_datatype_string

    kinds = [pa.int64() if t == "bigint" else pa.binary() if t == "binary" else pa.string() for t in (f.split()[1] for f in RECORDS.split(", "))]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows, size = [], 0
                    for head, block in parse(stream):
                        if row := _fields(head, block):
                            rows.append(row)
                            size += len(block) + 500
                        if size >= batch_bytes:
                            yield batch_of(rows)
                            rows, size = [], 0
                    yield batch_of(rows)

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(run, _parse_datatype_string(RECORDS))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, target_uri, record (the response or revisit), request, metadata.

    request and metadata records are joined to the response or revisit that their WARC-Concurrent-To
    names; several of one kind are kept in an array. A capture without either has an empty array.
    A revisit gets payload_bytes and payload_digest of the response that it refers to, or what its own
    headers declare if that is not in the archives.
    """
    answers = records.where(F.col("type").isin("response", "revisit")).select(
        "record_id", "target_uri", F.struct("record_id", "type", "refers_to", "date", "declared_digest", "declared_bytes", "payload", "payload_bytes", "payload_digest").alias("record")
    )
    side = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    parts = side.groupBy(F.col("concurrent_to").alias("record_id")).agg(
        F.collect_list(F.when(F.col("type") == "request", F.struct("record_id", "target_uri"))).alias("request"),
        F.collect_list(F.when(F.col("type") == "metadata", F.struct("record_id", "page_id"))).alias("metadata"),
    )
    # The planner knows only the small manifest that the records come from, so it would broadcast
    # them; both joins are told to shuffle and sort, and adaptive execution splits a hot key.
    whole = answers.join(parts.hint("merge"), "record_id", "left").withColumn("page_id", F.try_element_at("metadata", F.lit(1))["page_id"])
    stored = whole.where(F.col("record.type") == "response").select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("record.payload_bytes").alias("_bytes"), F.col("record.payload_digest").alias("_digest"))
    # What refers to nothing gets a key of its own that no record has, so these rows are spread.
    refers = F.coalesce("record.refers_to", F.concat(F.lit("nothing, from "), "record_id"))
    joined = whole.withColumn("_refers", refers).join(stored.hint("merge"), F.col("_refers") == F.col("_id"), "left")
    return joined.select(
        "page_id", "target_uri", "record", F.coalesce("request", F.array()).alias("request"), F.coalesce("metadata", F.array()).alias("metadata"),
        F.coalesce("record.payload_bytes", "_bytes", "record.declared_bytes").alias("payload_bytes"),
        F.coalesce("record.payload_digest", "_digest", "record.declared_digest").alias("payload_digest"),
        F.col("_page").alias("refers_to_page"),
    )


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """The captures of archives written from pages (page_id, url, html) in the shared folder and read back.

    The archives are parsed once, into a table of records in the shared folder that the joins read. With
    payloads=False each payload is read, measured and digested, but not kept: record.payload is null.
    Columns other than those three are left aside, whatever their names. A long page is one record, held whole by one task.
    Null html: an empty payload. Null url or page_id: the field is left out and read back as null; a
    control character or blank in a url is percent-encoded. Repeated rows are captures of their own;
    of equal payloads of at least 100 bytes one row with the smallest page_id is the response (null
    sorts last), all others are revisits. An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = common.scratch_path(spark, "warc")
    records = read(spark, write(plan(pages), folder), folder)
    if not payloads:
        records = records.withColumn("payload", F.lit(None).cast("binary"))
    return assemble(common.cut(records, "warc-records"))
