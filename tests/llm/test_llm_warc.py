"""Archives: round trips, reading by length, and assembly."""

import gzip
import hashlib

import pytest

from loomgrid.llm import warc

PAGES = "page_id long, url string, html string, payload string, digest int"
BIG = "é" * 600


def told(rows):
    sizes = {}
    for i, _, html, *_ in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            sizes[html] = max(sizes.get(html, i), i)
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        keeper = sizes.get(html)
        refers = keeper if keeper is not None and keeper != i else None
        kind = "response" if refers is None else "revisit"
        out.append((str(i), len(data), hashlib.sha1(data).hexdigest(), kind, str(refers), True))
    return sorted(out)


def test_round_trip_of_all_kinds_of_pages(spark):
    trap = "text\r\n\r\nWARC/1.1\r\nWARC-Type: request\r\n\r\n" + "z" * 2000
    rows = [
        (1, "http://a.org/x?y", BIG), (2, "http://b.org", BIG), (3, None, BIG), (4, "no url\r\nX: y", "small"), (5, "u", "small"),
        (6, "u", None), (7, "u", ""), (8, "u", trap), (9, "u", trap), (9, "u", trap), (None, "u", BIG), (10, "u", "w" * 3_000_000),
    ]
    rows = [(*r, "p", 1) for r in rows]
    got = warc.archive_and_read(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], str(r[4]), r[5]) for r in got) == told(rows)
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_nested_captures_keep_their_payload(spark, tmp_path):
    rows = [(i, f"http://h.org/{i}", f"<p>{i}</p>" * 200) for i in (1, 2, 3)] + [(4, "http://h.org/4", "<p>1</p>" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w")
    got = {r["response"]["target_uri"]: r for r in warc.assemble(warc.read_records(spark, f"{tmp_path}/w")).collect()}
    for i, url, html in rows:
        r = got[url]
        assert r["request"]["record_type"] == "request" and r["metadata"]["fields"]["payload-length"] == str(len(html))
        revisit = html == rows[3][2] and i != 4
        assert r["response"]["record_type"] == ("revisit" if revisit else "response")
        assert bytes(r["response"]["payload"]).decode() == ("" if revisit else html)


def record(kind, name, block, extra=""):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_records_of_other_writers(spark, tmp_path):
    one = record("response", "<a>", b"HTTP/1.1 200 OK\r\n\r\nbody", "Content-Type: application/http\r\n")
    two = record("metadata", "<m>", b"k: v\r\n", "WARC-Concurrent-To: <gone>\r\nContent-Type: application/warc-fields\r\n")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "plain.warc").write_bytes(one + two)
    (tmp_path / "x" / "members.warc.gz").write_bytes(gzip.compress(one.replace(b"<a>", b"<b>")) + gzip.compress(two.replace(b"<m>", b"<n>")))
    records = warc.read_records(spark, f"{tmp_path}/x")
    assert records.count() == 4
    captures = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert set(captures) == {"<a>", "<b>", "<gone>"}
    assert bytes(captures["<b>"]["response"]["payload"]) == b"body"
    assert captures["<gone>"]["response"] is None and captures["<gone>"]["metadata"]["fields"] == {"k": "v"}
    with pytest.raises(ValueError):
        list(warc.parse(one[:-10]))
