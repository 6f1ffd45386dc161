"""WARC records in ZIP archives: a writer, and a reader that range-reads records without extracting members.

An archive is a ZIP file with two *stored* (uncompressed) members: ``archive/data.warc.gz`` holds one gzip member a WARC
record, the first being a ``warcinfo``; ``indexes/index.cdxj`` holds one line a page's record with its offset and length in the first.  The reader finds the
end-of-directory record from the file's tail, follows the ZIP64 locator where there is one, parses the central directory with
its ZIP64 extra fields, locates a member's first byte through its local header and reads the index; then each record is a byte range of the archive.

Writing: every record's digest is taken first; of records with equal payloads of at least ``min_revisit`` bytes the one with the largest page_id
is the response and the others are revisits that refer to it.  Pages are dealt by page_id, so a hot payload is spread over all tasks; each task
writes archives of about ``archive_bytes`` under a name of its own attempt, and only names in the committed manifest count.
Reading: index lines are read first, then dealt anew, so large archives are read by many tasks.

Archives go to the shared folder through Arrow's file systems.  Edge cases: null html is an empty payload; a null url gives an empty
target; rows with one page_id and payload get the same decision (two responses if it is the largest); a null page_id is written as an empty id, never leads unless alone and comes back null (equal payloads without any id stay responses); records carry
the time of writing, or a given ``date``, as WARC-Date; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hot, table

ARCHIVE_BYTES, MIN_REVISIT = 256 << 20, 0
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
CRLF = b"\r\n"
# fixed values: Hadoop's names of schemes that Arrow knows by another
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


# --- records ---------------------------------------------------------------------------------------------------------


def info_record(name: str, date: str) -> bytes:
    """A gzip member with the ``warcinfo`` record that opens a file."""
    block = b"software: cinderlake\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2, 1, mtime=0)


def record(page_id: int | None, url: str, payload: bytes, sha: str, refers_to: int | None, size: int, revisit: bool, date: str) -> bytes:
    """A gzip member with one WARC record; a revisit keeps the HTTP header, with the full payload's length, and no payload."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b"", b""])
    block = http if revisit else http + payload
    name = lambda i: "" if i is None else str(i)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{name(refers_to)}>"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2, 1, mtime=0)


def parse(raw: bytes) -> dict:
    """The WARC headers (lower-cased names), HTTP headers and payload of a record."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(CRLF * 2)
    lines = head.decode().split("\r\n")
    warc = dict((k.lower(), v) for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]))
    block = rest[: int(warc["content-length"])]
    http_head, _, payload = block.partition(CRLF * 2)
    http = dict((k.lower(), v) for k, v in (x.split(": ", 1) for x in http_head.decode().split("\r\n")[1:] if ": " in x))
    return {"version": lines[0], "warc": warc, "http": http, "payload": payload}


# --- ZIP reading -----------------------------------------------------------------------------------------------------


def read_range(f, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"archive ends within a range of {n} bytes at {at}")
    return got


def central_directory(f, size: int) -> list[tuple[str, int, int, int, int]]:
    """(name, method, stored bytes, full bytes, offset of the local header) of each member."""
    tail = read_range(f, max(0, size - 65557), min(size, 65557))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, entries, length, begin, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    end = max(0, size - 65557) + at
    if end >= 20 and (locator := read_range(f, end - 20, 20)).startswith(b"PK\x06\x07"):
        wide = read_range(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if not wide.startswith(b"PK\x06\x06"):
            raise ValueError("the ZIP64 locator points at no ZIP64 record")
        entries, length, begin = struct.unpack_from("<QQQ", wide, 32)
    out, p, raw = [], 0, read_range(f, begin, length)
    for _ in range(entries):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, p + 8)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, p + 20)
        (header,) = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = raw[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # ZIP64: only the fields that overflow, in this order
                wide, r = extra[q + 4 : q + 4 + n], 0
                if full == 0xFFFFFFFF:
                    (full,) = struct.unpack_from("<Q", wide, r)
                    r += 8
                if packed == 0xFFFFFFFF:
                    (packed,) = struct.unpack_from("<Q", wide, r)
                    r += 8
                if header == 0xFFFFFFFF:
                    (header,) = struct.unpack_from("<Q", wide, r)
            q += 4 + n
        out.append((name, method, packed, full, header))
        p += 46 + n_name + n_extra + n_note
    return out


def locate(f, size: int, name: str) -> tuple[int, int]:
    """First byte and length of a stored member."""
    for found, method, packed, _, header in central_directory(f, size):
        if found == name:
            if method != zipfile.ZIP_STORED:
                raise ValueError(f"{name} is compressed; only stored members can be range-read")
            n_name, n_extra = struct.unpack_from("<HH", read_range(f, header, 30), 26)
            return header + 30 + n_name + n_extra, packed
    raise KeyError(name)


def read_index(f, size: int) -> list[tuple[int, int]]:
    """(offset in the archive, length) of each record."""
    base, _ = locate(f, size, DATA)
    at, n = locate(f, size, INDEX)
    entries = (json.loads(line.split(" ", 2)[2]) for line in read_range(f, at, n).decode().splitlines())
    return [(base + e["offset"], e["length"]) for e in entries]


# --- Spark -----------------------------------------------------------------------------------------------------------


def _open_fs(uri: str):
    """Arrow's file system and path for a folder that Spark names."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}" if not uri.startswith("dbfs:") else f"file:///dbfs{uri.removeprefix('dbfs:')}"
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


class _Archive:
    """One ZIP file being written: records go straight into the stored member, the index follows."""

    def __init__(self, system, path: str, date: str):
        self.sink = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = self.member.write(info_record(path.rsplit("/", 1)[-1], date)), []

    def add(self, page_id: int | None, url: str, raw: bytes) -> None:
        self.member.write(raw)
        self.lines.append(f"{'-' if page_id is None else page_id} 0 " + json.dumps({"url": url, "offset": self.at, "length": len(raw)}))
        self.at += len(raw)

    def close(self) -> int:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.sink.close()
        return len(self.lines)


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def digests(pages: DataFrame) -> DataFrame:
    """page_id, sha (hexadecimal), size: of each page's payload."""
    return pages.select("page_id", F.sha1(_payload().cast("binary")).alias("sha"), F.octet_length(_payload()).cast("long").alias("size"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = MIN_REVISIT, date: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``folder``; returns the manifest: archive, records."""
    scratch, date = Scratch(pages.sparkSession, "warc"), date or now()
    known = scratch.keep(digests(pages), "digests")
    long_enough = known.filter(F.col("size") >= min_revisit).select("page_id", "sha")
    leaders = long_enough.groupBy("sha").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).filter("n > 1 AND leader IS NOT NULL")
    # only pages with copies get a row here; a page without one is a response
    copies = join_hot(long_enough, leaders, ["sha"], "n", known.count()).filter("page_id IS NULL OR page_id <> leader").select("page_id", "sha", "leader").distinct()
    page, c = pages.select("page_id", "url", "html", F.sha1(_payload().cast("binary")).alias("sha")).alias("p"), copies.alias("c")
    rows = page.join(c, F.col("p.page_id").eqNullSafe(F.col("c.page_id")) & (F.col("p.sha") == F.col("c.sha")), "left").select("p.page_id", "url", "html", "p.sha", "leader")
    system_uri = folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open_fs(system_uri)
        archive, made = None, []
        for batch in batches:
            for page_id, url, html, sha, leader in zip(*(batch.column(c) for c in range(5)), strict=True):
                page_id, url, payload, leader = page_id.as_py(), url.as_py() or "", (html.as_py() or "").encode(), leader.as_py()
                if archive is None:
                    path = f"{root}/archive-{uuid.uuid4().hex}.zip"
                    archive = _Archive(system, path, date)
                said = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                archive.add(page_id, url, record(page_id, url, payload, said, leader, len(payload), leader is not None, date))
                if archive.at >= archive_bytes:
                    made.append((path, archive.close()))
                    archive = None
        if archive is not None:
            made.append((path, archive.close()))
        yield pa.RecordBatch.from_pydict({"archive": [m[0] for m in made], "records": [m[1] for m in made]}, pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    system, root = _open_fs(folder)
    system.create_dir(root, recursive=True)
    return scratch.keep(rows.mapInArrow(run, "archive string, records long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, deal: int | None = None) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits) of each record of the listed archives."""
    spark = manifest.sparkSession
    scheme = folder

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open_fs(scheme)
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                with system.open_input_file(path) as f:
                    found = read_index(f, f.size())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["archive", "at", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open_fs(scheme)
        number = lambda s: int(s) if (s := s.removeprefix("<urn:page:").removesuffix(">")) else None
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # payloads of a few records at a time
                rows = []
                wanted = zip(*(c.to_pylist() for c in batch.slice(a, 256).columns), strict=True)
                for path, ranges in itertools.groupby(wanted, key=lambda x: x[0]):
                    with system.open_input_file(path) as f:
                        for _, at, n in ranges:
                            r = parse(read_range(f, at, n))
                            kind, said = r["warc"]["warc-type"], r["warc"]["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "response" and digest(r["payload"]) != said:
                                raise ValueError(f"{path} at {at}: the payload does not have its digest")
                            rows.append((number(r["warc"]["warc-record-id"]), r["warc"]["warc-target-uri"], kind, number(r["warc"].get("warc-refers-to", "")), said, int(r["http"]["content-length"]), r["payload"] if kind == "response" else None))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

    ways = deal or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # runs of neighbouring records stay together
    ranges = manifest.select("archive").mapInArrow(index, "archive string, at long, length long").repartition(ways, "archive", F.expr("at div 4194304")).sortWithinPartitions("archive", "at")
    return ranges.mapInArrow(fetch, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "archives")
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch.root)
    return read_archives(manifest, scratch.root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# DuckDB has sha1 as hex: each 5 hex digits are 4 base-32 letters.
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha1(coalesce(html, '')), {a}, 5) AS BIGINT) >> {s}) & 31 AS INTEGER), 1)"
ORACLE = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         {" || ".join(_LETTER.format(a=1 + 5 * k, s=s) for k in range(8) for s in (15, 10, 5, 0))} AS payload_digest
  FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS leader FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> leader THEN leader END AS refers_to
FROM r
"""
