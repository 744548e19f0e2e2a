from __future__ import annotations

import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from runlens.llm import warc

LONG = "é日" * 9000
ROWS = [
    (5, "u5", "<p>a</p>"), (3, "u3", "<p>a</p>"), (8, "u8", None), (9, "u9", ""), (1, "u1", LONG), (2, "u2", LONG + "x"), (7, "u7", LONG),
    (10, "u10", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (11, "u11", "WARC/1.1\r\n"), (12, None, "0\r\n\r\n"), (13, "two\r\nlines", "ok"),
    (14, "u14", "w" * 4093 + "\r\n\r\nWARC/1.1\r\n"), (20, "b", "twice"), (20, "a", "twice"), (None, "n", "null id"), (None, "n", "null id"),
    (21, "z", "WARC" * 5000 + "/1.1\r\n"),
]


def _expected(rows, least):
    out = []
    for i, (page, url, html) in enumerate(rows):
        payload = (html or "").encode()
        alike = [(p is None, p or 0, u or "", j) for j, (p, u, h) in enumerate(rows) if (h or "") == (html or "")]
        first = min(alike)
        response = len(payload) < least or first[3] == i
        keep = rows[first[3]][0]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "response" if response else "revisit", None if response else keep))
    return sorted(out, key=repr)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, block string")


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, pages, tmp_path, least):
    path = f"{tmp_path}/archives"
    warc.write_archives(warc.records(pages, least_bytes=least), path)
    assert sorted(map(tuple, warc.page_records(spark, path).collect()), key=repr) == _expected(ROWS, least)


def test_archives_are_records_of_stated_length(spark, pages, tmp_path):
    path = f"{tmp_path}/archives"
    warc.write_archives(warc.records(pages), path)
    kinds = []
    for name in glob.glob(f"{path}/part-*"):
        data, at = gzip.open(name).read(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:])
            kinds.append(head[b"WARC-Type"])
            at = end + 4 + int(head[b"Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
    assert kinds.count(b"response") + kinds.count(b"revisit") == len(ROWS) and kinds.count(b"continuation") > 3


def test_segments_in_any_order_and_a_lost_one(spark, pages, tmp_path):
    records = warc.records(pages).orderBy(F.desc("value"))
    warc.write_archives(records.coalesce(1), f"{tmp_path}/sorted")
    assert warc.page_records(spark, f"{tmp_path}/sorted").count() == len(ROWS)
    warc.write_archives(records.where(~F.col("value").contains("WARC-Segment-Number: 2")), f"{tmp_path}/lost")
    with pytest.raises(Exception, match="segments do not fit"):
        warc.page_records(spark, f"{tmp_path}/lost").count()


@pytest.mark.parametrize("ending, opened", [("warc", open), ("warc.gz", gzip.open)])
def test_records_that_end_where_a_buffer_does(spark, tmp_path, ending, opened):
    # The reader's buffer has 64 KB. A chunked body and the end of its record are four line ends, of which each lies there once.
    rows = [(i, f"u{i}", f"é{i}") for i in range(64)]
    values = [r.value.encode() for r in warc.records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert all(v.endswith(b"0\r\n\r\n") for v in values)
    for i, (first, second) in enumerate(zip(values[::2], values[1::2])):
        size = 65536 - 20 + i - len(first)
        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i:{i}>\r\nContent-Length: {size - 90:06d}\r\n\r\n"
        info += "x" * (size - 90) + "\r\n\r\n"
        with opened(f"{tmp_path}/{i}.{ending}", "wb") as f:
            f.write(info.encode() + b"".join(v + b"\r\n\r\n" for v in (first, second)))
    assert sorted(r.page_id for r in warc.page_records(spark, str(tmp_path)).collect()) == [r[0] for r in rows]


def test_a_cut_record_is_an_error(spark, pages, tmp_path):
    cut = warc.records(pages).withColumn("value", F.expr("left(value, length(value) - 3)"))
    warc.write_archives(cut, f"{tmp_path}/cut")
    with pytest.raises(Exception, match="record is cut"):
        warc.page_records(spark, f"{tmp_path}/cut").count()


def test_dechunk():
    assert warc.dechunk(b"3;x=y\r\nabc\r\nA\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    with pytest.raises(ValueError):
        warc.dechunk(b"3\r\nabcd\r\n0\r\n\r\n")
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain", False) == b"plain"


def test_digest(spark):
    for payload in (b"", b"abc", bytes(range(256))):
        (row,) = spark.range(1).select(warc.payload_digest(F.lit(bytearray(payload)))).collect()
        assert row[0] == base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_empty(spark, tmp_path):
    warc.write_archives(warc.records(spark.createDataFrame([], "page_id long, url string, html string")), f"{tmp_path}/none")
    assert warc.page_records(spark, f"{tmp_path}/none").count() == 0
