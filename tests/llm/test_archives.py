"""Legacy archives to WARC and back."""

import hashlib

import pytest

from respmosaic.llm import warc
from respmosaic.llm.storage import folder

BIG = "<p>" + "payload " * 200 + "é</p>"
PAGES = [
    (1, "http://a.example/x y", BIG), (2, "http://b.example/ü", BIG), (9, None, BIG), (9, None, BIG), (None, "http://c.example", BIG), (3, "u", None), (4, "", ""), (5, "u", "small"), (6, "u", "small"),
    (7, "u", "text\r\n\r\nWARC/1.1\r\nhttp://x 0.0.0.0 20260101000000 text/html 5\n" * 30), (8, "u", "x" * 3_000_000), (10, "u", "z" * 999), (11, "u", "z" * 999), (12, "u", "y" * 1000), (13, "u", "y" * 1000),
]


def expected():
    best = {}
    for p, _, h in PAGES:
        if p is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, p), p)
    for p, _, h in PAGES:
        raw = (h or "").encode()
        again = h in best and len(raw) >= 1000 and (p is None or p < best[h])
        yield p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best[h] if again else None


def test_digest(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    got = [tuple(r) for r in warc.digest(pages).collect()]
    assert sorted(got, key=str) == sorted(expected(), key=str)
    assert warc.digest(pages.where("false")).count() == 0


def test_archives_hold_payloads_and_both_versions(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(4)
    arc, out = folder(spark, "t-arc"), folder(spark, "t-warc")
    warc.write_arc(pages, arc)
    rows = warc.read_arc(spark, arc).collect()
    one = folder(spark, "t-arc")
    warc.write_arc(pages.coalesce(1), one)  # a single task writes both versions
    heads = {bytes(r["content"]) for r in warc._files(spark, one).collect()}
    assert {warc._plain(h).split(b"\n")[1][:1] for h in heads} == {b"1", b"2"} and sorted(bytes(r["payload"]) for r in warc.read_arc(spark, one).collect()) == sorted(bytes(r["payload"]) for r in rows)
    assert sorted((r["payload"] for r in rows), key=bytes) == sorted((bytearray((h or "").encode()) for *_, h in PAGES), key=bytes)
    warc.convert(spark, arc, out)
    back = warc.read_warc(spark, out).collect()
    assert {(warc.page_number(r["uri"]), bytes(r["payload"])) for r in back if r["payload"] is not None} <= {(p, (h or "").encode()) for p, _, h in PAGES}
    urls = {warc.page_number(r["uri"]): warc.original_url(r["uri"]) for r in back}
    assert urls[1] == "http://a.example/x y" and urls[2] == "http://b.example/ü" and urls[9] == "-"
    ids = {r["record_id"] for r in back if r["record_type"] == "response"}
    assert len({r["record_id"] for r in back}) == len(PAGES) - 1  # a repeated page is the same record
    assert ids and all(r["date"] == "2026-01-01T00:00:00Z" for r in back)


def test_version_blocks_and_bad_headers():
    two = b"filedesc://x 0.0.0.0 20200101 text/plain 200 - - 0 - 60\n" + (b"2 0 org\n" + b"URL IP-address ...").ljust(60, b" ") + b"\n\nhttp://u 1.2.3.4 19970102030405 text/html 404 - - 0 - 5\nhello\n"
    r = list(warc.parse_arc(two))
    assert len(r) == 1 and r[0]["status"] == 404 and r[0]["payload"] == b"hello" and r[0]["date"] == "19970102030405"
    for bad in (b"http://u 1.2.3.4 1997 text/html 500 x 5\nhello\n", b"http://u 1.2.3.4 1997 text/html 50\nhello\n", b"http://u"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))
