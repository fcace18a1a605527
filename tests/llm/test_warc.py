import base64
import gzip
import hashlib

import pytest

from panelcast.llm import warc
from panelcast.llm.common import scratch


def test_record_round_trip():
    for payload in (b"", "é\r\n\r\nx".encode(), b"a" * 10**6):
        data, digest = warc.record(5, "http://x/ y", payload, None)
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        assert warc.parse(data) == (5, "http://x/y", len(payload), digest, "response", None, payload)
    data, digest = warc.record(None, None, b"abc", 3)
    assert warc.parse(data) == (None, None, 3, digest, "revisit", 3, b"")
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, None, b"abc", None)[0].replace(b"abc", b"abd"))


def test_write_index_and_read_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    monkeypatch.setattr(warc, "READ_BYTES", 700)
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 5), "x") for i in range(60)]
    rows += [(3, "http://h/3", "<p>3</p>" * 3, "x"), (100, None, None, "x"), (101, "u", "", "x"), (None, "n", "<p>1</p>", "x"), (None, "n", "nobody", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    folder = scratch(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    out = warc.read_records(index, folder).collect()
    assert len(out) == len(rows) and index.select("file").distinct().count() > 4
    first, by_id = {}, {}
    for page, _, html, _ in rows:
        by_id.setdefault(page, set()).add((html or "").encode())
        if page is not None:
            first[(html or "").encode()] = min(page, first.get((html or "").encode(), page))
    for r in out:
        payload = next(p for p in by_id[r["page_id"]] if base64.b32encode(hashlib.sha1(p).digest()).decode() == r["payload_digest"])
        to = first.get(payload)
        if to is None or to == r["page_id"]:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, payload)
        else:
            assert (r["record_type"], r["refers_to"]) == ("revisit", to)
        assert r["payload_bytes"] == len(payload)
    some = warc.read_records(index.filter("page_id % 3 = 0"), folder, payload=False).collect()
    assert sorted(r["page_id"] for r in some) == sorted(p for p, *_ in rows if p is not None and p % 3 == 0)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_archives_are_plain_warc_gz(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>")], "page_id long, url string, html string")
    folder = scratch(spark, "warc-test")
    row = warc.write_archives(pages, folder).first()
    data = gzip.open(f"{folder.removeprefix('file://')}/{row['file']}").read()
    assert data == warc.record(1, "http://a/", b"<p>x</p>", None)[0]


def test_registered_query_holds_the_contract(spark):
    from panelcast.llm.queries import op8_warc

    out = op8_warc(spark, "/root/testdata/sf0.01").collect()
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert {r["page_id"] for r in out} == set(pages) and len(out) == len(pages)
    for r in out:
        p = pages[r["page_id"]]
        assert r["payload_bytes"] == len(p) and r["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode()
        to = min(k for k, v in pages.items() if v == p)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if to == r["page_id"] else ("revisit", to))
