import gzip
import hashlib

import pytest
from helpers import against_sql, rows_of

from reportloom.llm import warc
from reportloom.llm.queries_warc import ORACLE, op9_warc_archive

PAGES = "page_id long, url string, html string"
BIG = "<p>" + "grün " * 40 + "</p>\r\n\r\nWARC/1.1\r\n\r\n"


def rows():
    return [
        (5, "http://a/x y", BIG), (2, "http://b", BIG), (2, "http://b", BIG), (9, None, BIG), (3, "http://c", "short"), (4, "http://d", "short"), (6, "http://e\r\nX: y", None), (7, "", ""),
        (None, "http://n", BIG), (None, None, None), (8, "http://z", "z" * 100), (1, "http://z", "z" * 100), (10, "http://y", "y" * 99), (11, "http://y", "y" * 99), (12, "http://long", "l" * 300_000),
    ]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    info = warc.version_block(version)
    block = b"HTTP/1.0 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    data = info + warc.arc_record(version, "http://a/b c", "20010203040506", "text/html", block) + warc.arc_record(version, "dns:x", "20010203", "text/dns", b"\n\nhttp://no 1 2 3 4\n")
    got = list(warc.read_arc(data))
    assert [h["URL"] for h, _ in got] == ["filedesc://legacy.arc", "http://a/b c", "dns:x"] and got[1][1] == block and got[2][1] == b"\n\nhttp://no 1 2 3 4\n"
    ((header, body),) = warc.read_warc([warc.to_warc(*got[1], {}) + b"\r\n\r\n"])
    assert header["WARC-Type"] == "response" and header["WARC-Date"] == "2001-02-03T04:05:06Z" and body == block
    assert header["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"abc").hexdigest()
    types = [next(warc.read_warc([warc.to_warc(h, b, {})]))[0]["WARC-Type"] for h, b in got]
    assert types == ["warcinfo", "response", "resource"]


def test_damage_is_reported():
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.version_block(1) + b"http://a 0.0.0.0 20010101000000 text/html 50\nshort\n"))
    with pytest.raises(ValueError):
        list(warc.read_arc(b"no header\nabc"))
    with pytest.raises(ValueError):
        list(warc.read_warc([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))


def test_streams_in_small_pieces():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    data = record * 3
    assert [b for _, b in warc.read_warc(data[i : i + 3] for i in range(0, len(data), 3))] == [b"ab\r\nc"] * 3
    assert b"".join(warc.gunzip(gzip.compress(data) + gzip.compress(b"x"))) == data + b"x"


def test_matches_sql(spark, tmp_path):
    pages = spark.createDataFrame([r for r in rows() if r[0] is not None], PAGES)
    assert against_sql(spark, op9_warc_archive, ORACLE["op9_warc_archive"], tmp_path, pages=pages) == 13


def test_edges_round_trip(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(rows(), PAGES).select("*", F.lit("x").alias("digest"), F.lit("y").alias("refers_to"))
    got = warc.read_archive(spark, warc.archive(pages, version=2)).collect()
    assert len(got) == 15
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [(r.record_type, r.refers_to) for r in by[5] + by[9]] == [("revisit", 2)] * 2
    assert sorted((r.record_type, r.refers_to) for r in by[2])[0] == ("response", None) and sorted(r.record_type for r in by[2]) == ["response", "revisit"]
    assert all(r.record_type == "response" for r in by[None] + by[3] + by[4] + by[10] + by[11])
    assert by[6][0].url == "http://e%0D%0AX: y" and by[9][0].url == "urn:page:9"
    assert len({r.record_id for r in got if r.page_id}) == 13
    empty = warc.read_archive(spark, warc.archive(pages.where("false")))
    assert rows_of(empty) == []
