import hashlib

import pytest

from tests.llm.util import clashing
from tidemark.llm import warc
from tidemark.session import scratch_path

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabcde\r\n\r\n"
BIG = "<p>é</p>" * 40
HTML = ["<html>a</html>", BIG, BIG, None, "", "WARC/1.0\r\n", "x" * 100, "x" * 100, "x" * 99, "x" * 99, FAKE, "before " + FAKE * 3 + " after", FAKE + BIG, FAKE + BIG,
        "\r\n\r\n\r\n\r\n", "WARC/1.0\r\n" * 500, "long " * 60_000, "WARC/1.0", "\r\n", "end\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n"]


def pages(spark, html=HTML):
    return spark.createDataFrame([(i, f"http://x/{i}" if i % 4 else "http://x/\r\nWARC/1.0\r\nü", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def brute(html):
    out, first = {}, {}
    for i, h in enumerate(html):
        b = (h or "").encode()
        keep = first.setdefault(b, i) if len(b) >= 100 else i
        out[i] = (len(b), hashlib.sha256(b).hexdigest(), "response" if keep == i else "revisit", None if keep == i else keep)
    return out


def read(rows):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows}


@pytest.mark.parametrize("split", ["128m", "300", "4000"])
def test_equals_brute_force(spark, split):
    """Small splits cut records, headers and the magic itself."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        path = scratch_path(spark, "warc")
        warc.write(warc.plan_records(clashing(pages(spark)).coalesce(2)), path, 9)
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        rows = warc.read(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == len(HTML) and all(r.intact for r in rows)
    assert read(rows) == brute(HTML)


def test_files_are_plain_archives(spark):
    """Read by walking each file from its start."""
    path = scratch_path(spark, "warc")
    warc.write(warc.plan_records(pages(spark).coalesce(1)), path, 6)
    seen = []
    for (data,) in spark.read.format("binaryFile").load(path).select("content").collect():
        data = bytes(data)
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.0\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            seen.append((fields[b"WARC-Record-ID"].decode(), rest[:n].split(b"\r\n\r\n", 1)[1], fields[b"WARC-Type"]))
            assert rest[n:n + 4] == b"\r\n\r\n"
            data = rest[n + 4:]
    assert sorted(s[0] for s in seen) == sorted(f"<urn:page:{i}>" for i in range(len(HTML)))
    assert all(p == (HTML[int(i[10:-1])] or "").encode() for i, p, t in seen if t == b"response")


def test_edges(spark):
    assert warc.round_trip(pages(spark).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, BIG), (7, None, BIG), (8, "u", BIG), (8, "u", BIG)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(odd).collect()), key=str)
    assert got == sorted([(None, "revisit", 7), (7, "response", None), (8, "revisit", 7), (8, "revisit", 7)], key=str)
