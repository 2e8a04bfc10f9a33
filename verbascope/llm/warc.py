"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Reading: archives are cut into byte ranges. A task scans its range for the
gzip magic, takes a hit for a member only if what follows inflates to a WARC
version line and a whole header block, and owns the records that start inside
its range, the last of them read past the range's end. A hit inside a member's
compressed bytes fails that test or, should it pass, lies before the end of
the member being read and is skipped.

Writing: each task streams its records to one file of a name of its own in the
shared folder, and reports the file once it is closed; only reported files
are read, so that a task run twice leaves a file that nobody reads.

The reader takes any version and any record type, header names in any case and
folded header lines; what isn't there is null. Files are opened by pyarrow,
which knows file, hdfs, s3 (and s3a, which is read as s3), gs and abfs.

Defined cases: a null html is the empty payload. Payloads of ``least`` bytes
or more that are equal share one response, at the largest page_id (null ids
come before all others); the other rows are revisits of it, and rows that
repeat that largest id are responses, too. Smaller payloads are all responses.
Urls and payloads of any length are written and read whole. An empty table
writes no file and reads as no rows. Columns other than page_id, url and html
aren't used, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbascope.llm.common import fresh_dir, give_up, remove, salt, salts, split, stored, table

LEAST = 1000
SPLIT_BYTES = 16 << 20
#: Beyond so many ranges, tasks read several.
MOST_TASKS = 50_000
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.0\r\n"
#: How the version line of a record begins, and what its header block holds.
VERSIONS = re.compile(rb"WARC/\d+\.\d+[ \t]*\r\n")
VERSION_BYTES = 32
LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*\d+[ \t]*\r\n")
PAGE = re.compile(r"<urn:page:(-?\d+)>\Z")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member; a revisit keeps the HTTP header, with the payload's length, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packed.compress(VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packed.flush()


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"\As3[an]://", "s3://", uri))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url, html, refers_to as archives in ``folder``; path and length of each file, one a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        length, sink = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                sink = sink or fs.open_output_stream(f"{base}/{name}", compression=None)
                payload = (row["html"] or "").encode()
                member = record(row["page_id"], row["url"], payload, hashlib.sha1(payload).hexdigest(), row["refers_to"])
                sink.write(member)
                length += len(member)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "length": pa.array([length], pa.int64())})

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, length long")


class Source:
    """Bytes of a file by position, read forward in blocks and held from ``keep`` on."""

    def __init__(self, file, length: int, block: int = 1 << 18):
        self.file, self.length, self.block = file, length, block
        self.at, self.held = 0, b""

    def get(self, start: int, n: int) -> bytes:
        if start < self.at or start > self.at + len(self.held):
            self.at, self.held = start, b""
        if start > self.at:
            self.at, self.held = start, self.held[start - self.at :]
        if len(self.held) < n and self.at + len(self.held) < self.length:
            self.file.seek(self.at + len(self.held))
            self.held += self.file.read(max(n - len(self.held), self.block))
        return self.held[:n]


def member(source: Source, start: int, test_only: bool = False) -> tuple[bytes, int] | None:
    """The whole content of the member at ``start`` and where it ends, or None if no WARC record starts there."""
    unpack, out, at, proven = zlib.decompressobj(31), bytearray(), start, False
    seen = 0
    while not unpack.eof:
        data = source.get(at, 1 << 16)
        if not data:
            return None
        try:
            out += unpack.decompress(data)
        except zlib.error:
            return None
        at += len(data) - len(unpack.unused_data)
        if not proven and (unpack.eof or len(out) >= VERSION_BYTES):
            if not VERSIONS.match(out):
                return None
            # the header block may be of any length; what has been searched isn't searched again
            end = out.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(out)
            if end < 0:
                if unpack.eof:
                    return None
                continue
            if not LENGTH.search(out, 0, end + 2):
                return None
            proven = True
            if test_only:
                break
    return bytes(out), at


def owned(source: Source, start: int, stop: int) -> Iterator[bytes]:
    """The records whose members start in [start, stop)."""
    at = start
    while at < stop:
        window = source.get(at, min(1 << 16, stop - at + len(MAGIC) - 1))
        if not window:
            return
        hit = window.find(MAGIC)
        if hit < 0:
            if at + len(window) >= stop + len(MAGIC) - 1 or len(window) < len(MAGIC):
                return
            at += len(window) - len(MAGIC) + 1
            continue
        at += hit
        if at >= stop:
            return
        found = member(source, at)
        if found is None:
            at += 1
        else:
            yield found[0]
            at = found[1]


def fields_of(block: bytes) -> dict[str, str]:
    """The named fields of a header block behind its first line, names in lower case; the first of a name counts."""
    out: dict[str, str] = {}
    for line in re.sub(r"\r\n[ \t]+", " ", block.decode("utf-8", "replace")).split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def parse(content: bytes) -> dict:
    """Header fields, HTTP header fields and payload of a record; a record without an HTTP message has its block for a payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = fields_of(head)
    payload, http = rest[: int(fields["content-length"])], {}
    if fields.get("content-type", "").lower().startswith("application/http"):
        header, _, payload = payload.partition(b"\r\n\r\n")
        http = fields_of(header)
    return {"fields": fields, "http": http, "payload": payload}


def row_of(content: bytes) -> dict:
    """A record as a row of ``read``."""
    got = parse(content)
    fields, kind = got["fields"], got["fields"].get("warc-type")

    def page(field: str) -> int | None:
        found = PAGE.match(fields.get(field, ""))
        return int(found[1]) if found else None

    row = {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": page("warc-refers-to")}
    if kind != "revisit":
        return row | {"payload_digest": hashlib.sha1(got["payload"]).hexdigest(), "payload_bytes": len(got["payload"]), "payload": got["payload"]}
    told = got["http"].get("content-length", "")
    return row | {"payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": int(told) if told.isdecimal() else None, "payload": None}


def ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row for each byte range of each file."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0).cast("long")), F.lit(split_bytes).cast("long")))
    return files.where("length > 0").select("path", "length", starts.alias("start")).withColumn("stop", F.least("length", F.col("start") + split_bytes))


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload of every record of ``files`` (path, length).

    ``payload_bytes`` is that of the full payload, for a revisit as its HTTP
    header tells; a revisit's payload is null.
    """
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for x in batch.to_pylist():
                fs, path = filesystem(x["path"])
                with fs.open_input_file(path) as file:
                    for content in owned(Source(file, x["length"]), x["start"], x["stop"]):
                        rows.append(row_of(content))
                        held += len(content)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=target)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    from verbascope.llm.common import _arrow_schema

    target = _arrow_schema(files.sparkSession, schema)
    cut = ranges(files, split_bytes)
    return cut.repartition(min(MOST_TASKS, max(1, cut.count()))).mapInArrow(run, schema)


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, refers_to: the page that a row of an equal payload refers to, or null."""
    html = F.coalesce(pages.html, F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"))
    none = F.lit(None).cast(rows.schema["page_id"].dataType)
    large = rows.where(F.octet_length("html") >= least).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # pages of an equal payload may be many: they are counted map-side first, told of their response by a salted join without
    # the payload, and found again by their own ids
    marks = large.select("page_id", "digest", salt("page_id").alias("salt"))
    again = marks.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"), salts()).where("n > 1").drop("n")
    told = marks.join(split(again), ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("last")))
    told = told.groupBy(F.col("page_id").alias("page"), F.col("digest").alias("of")).agg(F.max("last").alias("refers_to"))
    met = large.join(told, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("of")), "left")
    return met.select("page_id", "url", "html", "refers_to").union(rows.where(F.octet_length("html") < least).withColumn("refers_to", none))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").selectExpr("cast(page_id as long) page_id", "url", "html")
    folder = fresh_dir(spark, "warc")
    files = stored(write(with_revisits(pages), folder), "warc-files")
    out = stored(read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    remove(spark, folder)
    return out


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
k AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, lower(sha1(payload)) AS payload_digest FROM p),
l AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM k)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM l
"""
