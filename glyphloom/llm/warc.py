"""WARC archives as a PySpark Python data source, written and read in parallel.

Every record is a gzip member of its own whose extra field ``sl`` (skip lengths)
holds the member's size, so a reader that doesn't want a payload goes on to the
next record without inflating it. A write task starts a new file when one
reaches ``fileBytes``; the commit writes a manifest of the files of successful
tasks, so what lost or repeated tasks leave behind is never read.

Reading plans partitions from the manifest, whole files up to
``partitionBytes``. Predicates on ``record_type``, ``page_id``,
``payload_bytes``, ``payload_digest`` and ``refers_to`` are pushed down and
judged on the parsed headers; option ``payload=false`` leaves all payloads out.

Defined results: a null payload is written as an empty one; a null or odd URL is
written percent-encoded, so no value can break a header; a null id stays null;
an empty table gives an archive without files, which reads as no rows.
"""

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
                                    LessThanOrEqual, WriterCommitMessage)

from glyphloom.session import work_dir, written

SCHEMA = ("page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, "
          "refers_to bigint, payload binary")
MANIFEST = "_manifest-"     # and an id: every job that writes to a path leaves its own
_GZIP = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sH", 12, b"sl", 8)
_HEAD = len(_GZIP) + 8
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
          LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and "://" not in path else path)
    return pafs.LocalFileSystem(), path


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member with its own size in the extra field."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    return _GZIP + struct.pack("<II", _HEAD + len(body) + len(tail), len(record) & 0xFFFFFFFF) + body + tail


def _number(x) -> str:
    return "null" if x is None else str(x)


def record(page_id, url, record_type: str, payload_bytes: int, digest: str, refers_to, payload: bytes) -> bytes:
    """One WARC record; a revisit has no payload of its own."""
    block = payload if record_type == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{_number(page_id)}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {payload_bytes}", "Content-Type: text/html; charset=utf-8",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~-._')}")
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{_number(refers_to)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _id(value: str | None):
    number = value.rpartition(":")[2].rstrip(">") if value else "null"
    return None if number == "null" else int(number)


def parsed(head: bytes) -> dict:
    """Columns of a record's header block."""
    lines = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    h = {name.lower(): value for name, _, value in lines}
    url = h.get("warc-target-uri")
    return {"page_id": _id(h["warc-record-id"]), "url": None if url is None else unquote(url),
            "record_type": h["warc-type"], "payload_bytes": int(h["x-payload-length"]),
            "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
            "refers_to": _id(h.get("warc-refers-to")), "_length": int(h["content-length"])}


def records(data: memoryview, wanted=lambda row: True, payload: bool = True) -> Iterator[dict]:
    """Records of an archive, headers first; only wanted payloads are inflated."""
    at = 0
    while at < len(data):
        size = struct.unpack_from("<I", data, at + len(_GZIP))[0]
        inflate = zlib.decompressobj(-15)
        body = data[at + _HEAD:at + size - 8]
        text = inflate.decompress(body, 1024)
        while b"\r\n\r\n" not in text:
            more = inflate.decompress(inflate.unconsumed_tail, 1 << 16)
            if not more:
                raise ValueError("a WARC record without the end of its header")
            text += more
        end = text.index(b"\r\n\r\n")
        row = parsed(text[:end])
        if wanted(row):
            row["payload"] = None
            if payload:
                whole = text[end + 4:] + inflate.decompress(inflate.unconsumed_tail) + inflate.flush()
                row["payload"] = whole[:row["_length"]] if row["record_type"] == "response" else None
            yield row
        at += size


@dataclass
class _Files(InputPartition):
    paths: list

    def __init__(self, paths):
        self.paths = paths


@dataclass
class _Wrote(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.limit = int(options.get("filebytes", 64 << 20))
        self.level = int(options.get("level", 6))

    def write(self, iterator):
        fs, root = store(self.path)
        fs.create_dir(root, recursive=True)
        files, out = [], None
        for batch in iterator:
            columns = [batch.column(n).to_pylist() for n in
                       ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")]
            for row in zip(*columns):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                    files.append([name, 0])
                data = member(record(*row[:6], row[6] or b""), self.level)
                out.write(data)
                files[-1][1] += len(data)
                if files[-1][1] >= self.limit:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Wrote(files)

    def commit(self, messages):
        fs, root = store(self.path)
        fs.create_dir(root, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, root = store(self.path)
        for name, _ in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{root}/{name}")


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = schema.names
        self.arrow = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true" and "payload" in self.names
        self.limit = int(options.get("partitionbytes", 64 << 20))
        self.tests = []

    def pushFilters(self, filters):
        for f in filters:
            attribute = getattr(f, "attribute", ())     # Not, And and the like have none and stay with Spark
            column = attribute[0] if len(attribute) == 1 else ""
            if column in ("record_type", "page_id", "payload_bytes", "payload_digest", "refers_to") and (
                    type(f) in _TESTS or isinstance(f, IsNull | IsNotNull)):
                self.tests.append((type(f), column, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, row) -> bool:
        for kind, column, value in self.tests:
            have = row[column]
            if kind in (IsNull, IsNotNull):
                if (have is None) != (kind is IsNull):
                    return False
            elif have is None or not _TESTS[kind](have, value):
                return False
        return True

    def partitions(self):
        fs, root = store(self.path)
        files = []
        for found in fs.get_file_info(pafs.FileSelector(root)):
            if found.base_name.startswith(MANIFEST):
                with fs.open_input_stream(found.path, compression=None) as f:
                    files += json.loads(f.read())
        parts, size = [[]], 0
        for name, length in sorted(files):
            if parts[-1] and size + length > self.limit:
                parts.append([])
                size = 0
            parts[-1].append(f"{root}/{name}")
            size += length
        return [_Files(p) for p in parts]

    def read(self, partition):
        fs, _ = store(self.path)
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                data = memoryview(f.read())
            rows, size = [], 0
            for row in records(data, self.wanted, self.payload):
                rows.append(row)
                size += len(row["payload"] or b"")
                if len(rows) >= 5000 or size >= 16 << 20:
                    yield self.batch(rows)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows)

    def batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], self.arrow.get(n, pa.string()))
                                           for n in self.names], names=self.names)


class WarcSource(DataSource):
    """Format ``warc``; options path, fileBytes, level (writing), payload, partitionBytes (reading)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    """Make format ``warc`` known and let predicates reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def deduplicated(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Rows of ``pages`` (page_id, url, html) as records.

    Of equal payloads of at least ``least`` bytes the largest page_id responds
    and the others revisit it. Digests are compared, payloads don't move for
    that; the one join that marks the revisits is by digest, and a digest that
    many pages share is split by the join.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select(
        "page_id", "url", F.octet_length("html").cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        F.col("html").cast("binary").alias("payload"))
    keys = ["payload_digest", "payload_bytes"]
    again = written(rows.where(F.col("payload_bytes") >= least).groupBy(*keys)
                    .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    revisit = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return rows.join(again, keys, "left").select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "payload_bytes",
        "payload_digest", F.when(revisit, F.col("last")).alias("refers_to"),
        F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"))


def archived(pages: DataFrame, path: str | None = None, payload: bool = True) -> DataFrame:
    """Write ``pages`` as archives below ``path`` (the shared folder by default) and read them back."""
    spark = pages.sparkSession
    register(spark)
    path = path or work_dir(spark, "warc")
    deduplicated(pages).write.format("warc").mode("append").save(path)
    return opened(spark, path, payload)


def opened(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The archives below ``path``.

    Spark keeps the pushed predicates with the opened archive, not with a query's use of it:
    uses that differ in their predicates, as in a union, each open the archive for themselves.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


_COLUMNS = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]


def verified(archive: DataFrame) -> DataFrame:
    """Records of an archive with the length and the digest of the payload that is in it, in one pass.

    Those of revisits, which have no payload of their own, are what their headers say.
    """
    own = F.col("record_type") == "response"
    return archive.where("record_type is not null").withColumns({   # a predicate of its own, no other use's
        "payload_bytes": F.when(own, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")),
        "payload_digest": F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest"))}).select(*_COLUMNS)


def verified_at(spark: SparkSession, path: str) -> DataFrame:
    """``verified`` records of the archives below ``path``: a predicate that reaches the reader takes out
    the responses, which are decoded, and another one the revisits, of which only headers are read."""
    responses = verified(opened(spark, path).where("record_type = 'response'"))
    return responses.unionByName(opened(spark, path, payload=False).where("record_type = 'revisit'").select(*_COLUMNS))


def payload_sha1(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()
