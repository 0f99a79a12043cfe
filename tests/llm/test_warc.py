"""WARC archives: round trips, odd rows, foreign archives, and transactions that records link in several ways."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from llm import queries as Q
from llm._common import materialize
from llm.warc import _records, assemble, read_warc, write_warc
from tests.test_oracle import same_rows

BIG = "x" * 100


def plain(rows):
    """What the contract says of (page_id, html) rows, row by row."""
    of = [(p, (h or "").encode()) for p, h in rows]
    out = []
    for p, h in of:
        ids = [q for q, g in of if g == h and q is not None]
        first = min(ids) if ids and len(h) >= 100 else None
        out.append((p, len(h), hashlib.sha256(h).hexdigest(), "response" if first in (None, p) else "revisit", None if first in (None, p) else first))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a.example/x?y=1#z", BIG), (3, "http://a.example", BIG), (9, None, BIG), (None, "nowhere", BIG), (3, "http://a.example", BIG), (4, "http://b.example/\r\nEvil: 1", "y" * 99), (6, "http://b.example/", "y" * 99),
    (7, "", None), (8, "http://c.example/", ""), (10, "http://d.example/", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <u>\r\nContent-Length: 1\r\n\r\nb\r\n\r\nWARC/1.0 \U0001f600 \x00 end\r\n\r\n" * 3),
    (11, "http://d.example/", "\r\n\r\n"), (12, "http://e.example/", "﻿" + "é" * 3_000_000), (None, None, "n" * 100), (None, None, "n" * 100), (None, None, None),
]


def result(spark, rows, tmp_path, **extra):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for name, value in extra.items():
        pages = pages.withColumn(name, F.lit(value))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    return Q.op13_warc(spark, str(tmp_path))


def test_rows_come_back(spark, tmp_path):
    got = result(spark, ROWS, tmp_path, record="r", digest="d", payload="p", size=1, type="t", _rows=2, _first=3, **{"x.y": 1})
    assert sorted(map(tuple, got.collect()), key=str) == plain([(p, h) for p, _, h in ROWS])


def test_empty_table(spark, tmp_path):
    assert result(spark, [], tmp_path).count() == 0


def test_many_copies_refer_to_one_response(spark, tmp_path):
    rows = [(k, f"http://h{k}.example/", BIG if k % 3 else f"{k}" * 60) for k in range(1, 2500)]
    assert sorted(map(tuple, result(spark, rows, tmp_path).collect()), key=str) == plain([(p, h) for p, _, h in rows])


def test_records_of_an_archive(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/p?q", "<p>é</p>" * 30), (2, "http://b.example/", "<p>é</p>" * 30)], "page_id long, url string, html string")
    write_warc(pages, f"{tmp_path}/w", date="2024-01-02T03:04:05Z")
    assert all(f.read_bytes()[:2] == b"\x1f\x8b" for f in (tmp_path / "w").glob("part-*"))
    records = materialize(read_warc(spark, f"{tmp_path}/w"), "r")
    by = {(r.type, r.uri): r for r in records.collect()}
    first, again = by["response", "http://a.example/p?q"], by["revisit", "http://b.example/"]
    assert first.payload.decode() == "<p>é</p>" * 30 and first.intact and first.http_status == 200 and first.http_headers["content-type"] == "text/html; charset=utf-8" and first.date == "2024-01-02T03:04:05Z"
    assert again.payload is None and again.refers_to == first.record_id and (again.payload_bytes, again.payload_digest) == (first.payload_bytes, first.payload_digest)
    assert by["request", "http://a.example/p?q"].headers["content-type"].endswith("request") and by["metadata", "http://b.example/"].fields == {"page_id": "2"}
    captures = {r.uri: r for r in assemble(records).collect()}
    assert len(captures) == 2 and all(len(r.requests) == len(r.metadata) == 1 and r.requests[0].concurrent_to == [r.record_id] for r in captures.values())
    assert captures["http://a.example/p?q"].capture.payload == first.payload


def record(kind, ident, body=b"", *more):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + ident, *more, b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.0 404 Gone\r\nX-Long: a\r\n b\r\n\r\n\xff\xfe\x00"
    link = lambda x: b"WARC-Concurrent-To: " + x
    members = [
        record(b"warcinfo", b"<i>", b"software: x\r\n", b"Content-Type: application/warc-fields"), record(b"response", b"<r1>", http, b"Content-Type: application/http; msgtype=response", link(b"<q1>"), b"warc-payload-digest: sha256:00"),
        record(b"request", b"<q1>"), record(b"metadata", b"<m1>", b"a: 1\r\na: 2\r\n", link(b"<q1>"), b"Content-Type: application/warc-fields"),
        record(b"metadata", b"<m2>", b"", link(b"<gone>"), link(b"<r1>")), record(b"request", b"<q9>", b"", link(b"<nowhere>")), record(b"resource", b"<s>", b"12\r\n\r\nWARC/1.1 34"), record(b"metadata", b"<m2>", b"", link(b"<gone>"), link(b"<r1>")),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    (tmp_path / "empty.warc").write_bytes(b"")
    records = materialize(read_warc(spark, str(tmp_path)), "r")
    r1 = records.where("record_id = '<r1>'").first()
    assert (bytes(r1.payload), r1.http_status, r1.http_headers, r1.intact) == (b"\xff\xfe\x00", 404, {"x-long": "a b"}, False)
    assert bytes(records.where("record_id = '<s>'").first().payload) == b"12\r\n\r\nWARC/1.1 34" and records.count() == 8
    got = {r.record_id: (r.capture is not None, [x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in assemble(records).collect()}
    assert got == {"<r1>": (True, ["<q1>"], ["<m1>", "<m2>"]), "<s>": (True, [], []), "<q9>": (False, ["<q9>"], []), "<i>": (False, [], ["<i>"])}


def test_marks_that_the_reader_overlooks():
    import pyarrow as pa

    texts = [record(b"request", b"<q%d>" % k, b"GET / HTTP/1.1\r\n\r\n" * (k % 3)).removesuffix(b"\r\n\r\n") for k in range(6)]
    parts = [texts[0], (b"\r\n\r\n".join(texts[1:4])).removeprefix(b"WARC/"), texts[4].removeprefix(b"WARC/"), texts[5].removeprefix(b"WARC/") + b"\r\n\r\n"]
    got = [r for b in _records([pa.RecordBatch.from_pydict({"value": parts, "file": ["f"] * len(parts)})]) for r in b.to_pylist()]
    assert [(r["record_id"], r["payload"].count(b"GET")) for r in got] == [(f"<q{k}>", k % 3) for k in range(6)]


@pytest.mark.parametrize("text", [b"hello", record(b"response", b"<r>", b"12345")[:-7], b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n", record(b"response", b"<r>", b"12345").replace(b": 5", b": 3")])
def test_broken_archives_are_errors(spark, tmp_path, text):
    (tmp_path / "a.warc").write_bytes(text)
    with pytest.raises(Exception, match="WARC record"):
        read_warc(spark, str(tmp_path)).collect()


def test_query_agrees_with_rows(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    same_rows(Q.op13_warc(spark, sf_dir).toPandas(), con.execute(Q.SQL["op13_warc"]).fetch_df())
