"""WARC archives: an index of every record, archives of gzip members, and coalesced byte-range reads.

Writing.  Payload digests find the copies (one aggregation with partial sums; only digests of two or more records go on).  Each
task writes the records of its own share of the pages, one gzip member a record, to archives of about `archive_bytes`, so no
payload travels (unless there are more repeated digests than `small` sends to all tasks: then pages and digests are joined).
What a task returns is the index: archive, offset, length, url, digest and page id of each record.  Archives are named by
attempt, so a task that runs twice writes other files, and only those that the committed index names are ever read.
Copies of a payload become revisits of the record with the smallest page id; they keep the HTTP head of the original.

Reading.  The selected index rows are dealt out by archive and stretch of the file, sorted by offset, and ranges with small gaps
between them are read as one.  Each record's head is parsed, and the payload digest is computed again and compared.

The folder must be in a file system that pyarrow opens by its URI (a shared disk, HDFS, S3, ...); else writing fails at once.

Defined results: a null html is an empty payload; all empty payloads are copies of one another; rows that repeat the smallest
page id of a payload are all responses; a page without an id never is the smallest unless none has one; a null url is written
as about:blank; control characters and blanks in a url are percent-encoded; no pages make no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL, arrow_map, partitions, pieces, shared_path, small, staged

GAP, SPAN = 64 << 10, 8 << 20
#: Of deflate.
LEVEL = 1
PARSED = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, payload binary"
_END = "\r\n\r\n"


def digest32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: every ten hexadecimal digits are eight digits to base 32."""
    hexa = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexa, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, min_revisit: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """page_id, url, digest, record_type, refers_to, record (the bytes up to the closing blank lines)."""
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    own = own.withColumn("digest", digest32(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload"))
    light = pages.select("page_id", digest32(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("b"))
    copies = staged(light.where(F.col("b") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "copies")
    both = own.join(small(copies, SMALL >> 2), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    both = both.withColumn("refers_to", refers).withColumn("record_type", F.when(refers.isNull(), "response").otherwise("revisit"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("about:blank"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(F.col("record_type") == "response", F.col("payload")).otherwise(""))
    more = F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\n"))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Target-URI: "), uri,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"), more,
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END),
    )
    return both.select("page_id", "url", "digest", "record_type", "refers_to", F.concat(head, block).cast("binary").alias("record"))


INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"


def _write(path: str, archive_bytes: int):
    """Records to gzip members of archives in path; returns the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _system(path)
        part, sink, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, 0
        made = 0
        for b in pieces(batches, column="record"):
            where = []
            for record in b.column(5).to_pylist():
                if sink is None or at >= archive_bytes:
                    if sink is not None:
                        sink.close()
                    name, at, made = f"{part}-{made}.warc.gz", 0, made + 1
                    sink = system.open_output_stream(f"{inner}/{name}", compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = packer.compress(record) + packer.compress(_END.encode()) + packer.flush()
                sink.write(data)
                where.append((name, at, len(data)))
                at += len(data)
            types = (pa.string(), pa.int64(), pa.int64())
            own = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "digest", "record_type", "refers_to")]
            yield pa.RecordBatch.from_arrays([*(pa.array([w[k] for w in where], t) for k, t in enumerate(types)), *own], [c.split()[0] for c in INDEX.split(", ")])
        if sink is not None:
            sink.close()

    return run


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 64 << 20, min_revisit: int = 0) -> DataFrame:
    """Write archives of about archive_bytes to {path}/warc and their index to {path}/index (Parquet); returns the index."""
    spark = pages.sparkSession
    system, inner = _system(f"{path}/warc")
    system.create_dir(inner, recursive=True)
    rows = records(pages, min_revisit)
    rows = rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))
    arrow_map(rows, _write(f"{path}/warc", archive_bytes), INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)", re.M)


def parse_record(data: bytes) -> tuple:
    """A row of PARSED from the bytes of one record."""
    head, _, block = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v for k, v in _FIELD.findall(head)}
    block = block[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.lower(): v for k, v in _FIELD.findall(http)}
    kind = fields[b"warc-type"].decode()
    named = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else named
    size = len(payload) if kind == "response" else int(told[b"content-length"])
    ids = [None if (v := fields.get(k)) is None or v == b"<urn:page:none>" else int(v.removeprefix(b"<urn:page:").removesuffix(b">")) for k in (b"warc-record-id", b"warc-refers-to")]
    return ids[0], fields[b"warc-target-uri"].decode("utf-8", "replace"), kind, ids[1], size, digest, digest == named, payload


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, list[int]]]:
    """(start, end, numbers of the ranges within) for ranges (offset, length) sorted by offset: neighbours with at most `gap`
    bytes between them are one read of at most `span` bytes (or one range)."""
    out: list[tuple[int, int, list[int]]] = []
    for k, (a, n) in enumerate(ranges):
        if out and a - out[-1][1] <= gap and a + n - out[-1][0] <= span:
            start, end, own = out[-1]
            own.append(k)
            out[-1] = (start, max(end, a + n), own)
        else:
            out.append((a, a + n, [k]))
    return out


def _system(path: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
    names = [c.split()[0] for c in PARSED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] if k < 7 or with_payload else None for r in rows], t) for k, t in enumerate(types)], names)


def _read_ranges(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            at = 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end][0] == rows[at][0]:
                    end += 1
                if rows[at][0] != path:
                    if source is not None:
                        source.close()
                    path = rows[at][0]
                    system, inner = _system(path)
                    source = system.open_input_file(inner)
                part = [(o, n) for _, o, n in rows[at:end]]
                for a, z, own in coalesce_ranges(part):
                    source.seek(a)
                    data = source.read(z - a)
                    yield _batch([parse_record(zlib.decompress(data[part[k][0] - a : part[k][0] - a + part[k][1]], 31)) for k in own], with_payload)
                at = end
        if source is not None:
            source.close()

    return run


def read_archives(index: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """The records that the index rows name (any selection of them)."""
    ranges = index.select(F.concat(F.lit(f"{path}/warc/"), "archive").alias("path"), "offset", F.col("length").alias("size"))
    stretch = (F.col("offset") / F.lit(8 * SPAN)).cast("long")
    return arrow_map(ranges.repartition(partitions(index.sparkSession), "path", stretch).sortWithinPartitions("path", "offset"), _read_ranges(with_payload), PARSED)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc") + "/a"
    return read_archives(write_archives(pages, path), path, with_payload)
