import base64
import gzip
import hashlib
import io
import random
import zipfile

import pytest

from cinderlake.llm import warc
from cinderlake.llm.common import Scratch

SCHEMA = "page_id long, url string, html string, digest string, leader int"


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, least=0):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == payload and j is not None]
        lead = max(same, default=None) if len(payload) >= least else None
        revisit = lead is not None and i != lead
        out.append((i, len(payload), sha(payload), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=str)


def round_trip(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    folder = Scratch(spark, "test-archives").root
    manifest = warc.write_archives(pages, folder, **options)
    got = warc.read_archives(manifest, folder).collect()
    payload = {sha((h or "").encode()): (h or "").encode() for _, _, h in rows}
    assert all(r.payload == payload[r.payload_digest] for r in got if r.record_type == "response")
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)


@pytest.mark.parametrize("options", [{}, {"archive_bytes": 500}])
def test_round_trip(spark, options):
    rng = random.Random(2)
    pool = ["<p>é %d</p>" % k * rng.randrange(1, 60) for k in range(12)] + ["", None, "\r\n\r\nWARC/1.1\r\n"]
    rows = [(k, f"http://a.example/é ü?{k}\n", rng.choice(pool)) for k in range(70)]
    rows += [(3, None, rows[3][2]), (None, "u", "only with a null id"), (None, "u", pool[0]), (999, "", "x" * 200_000)]
    assert round_trip(spark, rows, **options) == brute(rows)


def test_records_have_the_mandatory_headers(spark):
    """Each archive's data member, read as a plain stream of gzip members: a warcinfo, then the pages, all with the four mandatory headers."""
    pages = spark.createDataFrame([(k, f"http://a.example/{k}", "same" if k % 3 else f"page {k}") for k in range(20)], "page_id long, url string, html string")
    folder = Scratch(spark, "test-headers").root
    manifest = warc.write_archives(pages, folder, date="2024-02-03T04:05:06Z").collect()
    kinds = []
    for row in manifest:
        with zipfile.ZipFile(row.archive) as z:
            data = gzip.decompress(z.read(warc.DATA))
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert lines[0] == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
            assert fields["WARC-Date"] == "2024-02-03T04:05:06Z" and fields["WARC-Record-ID"][0] + fields["WARC-Record-ID"][-1] == "<>"
            end = int(fields["Content-Length"])
            assert rest[end : end + 4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            data = rest[end + 4 :]
    assert kinds.count("warcinfo") == len(manifest) and kinds.count("response") == 8 and kinds.count("revisit") == 12


def test_schemes():
    assert warc._open_fs("file:/tmp/x")[1] == "/tmp/x" and warc._open_fs("dbfs:/x")[1] == "/dbfs/x" and warc._open_fs("/tmp/y")[1] == "/tmp/y"


def test_small_payloads_stay_responses(spark):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "longer"), (4, "d", "longer")]
    assert round_trip(spark, rows, min_revisit=4) == brute(rows, 4)


def test_empty_table(spark):
    assert round_trip(spark, []) == []


def test_zip64_directories(monkeypatch):
    """With the format's limits set low, the writer makes ZIP64 records for small files."""
    for limit in (None, 10):
        if limit:
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.comment = b"PK a comment"
            for name in ("a/first.bin", "é.txt", warc.DATA):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                    f.write(name.encode() * 3)
        data = out.getvalue()
        assert (b"PK\x06\x06" in data) == bool(limit)
        f = io.BytesIO(data)
        for name in ("a/first.bin", "é.txt", warc.DATA):
            at, n = warc.locate(f, len(data), name)
            assert data[at : at + n] == name.encode() * 3
        with pytest.raises(KeyError):
            warc.locate(f, len(data), "missing")


def test_compressed_members_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA, b"x" * 100)
    with pytest.raises(ValueError, match="stored"):
        warc.locate(out, len(out.getvalue()), warc.DATA)
