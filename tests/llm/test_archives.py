"""Legacy archives: parsing, conversion and round trips."""

from __future__ import annotations

import gzip
import hashlib

from dealgrain.llm import archives
from dealgrain.session import local_table


def test_versions_lengths_and_dates():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\nURL 1 2 text/html 5\n</p>"
    for version in (1, 2):
        data = archives.arc_opening(version, "x.arc", "19990102030405") + archives.arc_record(version, "http://a/b%20c", "1.2.3.4", "199901", "text/html; charset=x", block, 7, "x.arc")
        data += archives.arc_record(version, "dns:a", "-", "19990102030405", "text/dns", b"a. 1 IN A", 9, "x.arc")
        opening, page, dns = archives.read_arc(data)
        assert opening.kind == "warcinfo" and page.kind == "response" and dns.kind == "resource"
        assert page.block == block and page.payload == b"<p>\nURL 1 2 text/html 5\n</p>" and page.timestamp == "1999-01-01T00:00:00Z"
        assert page.content_type == "text/html; charset=x" and page.ip == "1.2.3.4" and dns.payload == b"a. 1 IN A"


def test_headers_without_an_address():
    data = archives.arc_opening(1, "x.arc", "19990102030405") + b"http://a/ 20000101000000 text/html 5\nhello\nhttp://b/ 1.2.3.4 1999 text/plain; x=y 2\nok\n"
    _, bare, full = archives.read_arc(data)
    assert (bare.ip, bare.date, bare.content_type, bare.block, bare.timestamp) == ("-", "20000101000000", "text/html", b"hello", "2000-01-01T00:00:00Z")
    assert (full.ip, full.date, full.content_type, full.block) == ("1.2.3.4", "1999", "text/plain; x=y", b"ok")
    assert b"WARC-IP-Address" not in archives.convert(bare, "f") and b"WARC-IP-Address: 1.2.3.4" in archives.convert(full, "f")


def test_noise_and_cut_records():
    data = archives.arc_opening(1, "x.arc", "19990102030405") + b"noise without a header\n\n" + archives.arc_record(1, "http://a/", "-", "19990102030405", "text/html", b"x" * 40)[:-11]
    records = list(archives.read_arc(data))
    assert [r.truncated for r in records] == [False, True] and len(records[1].block) == 30
    assert b"WARC-Truncated" in archives.convert(records[1], "f") and list(archives.read_arc(b"")) == []


def test_identifiers_and_digests():
    record = archives.ArcRecord(5, "http://a/", "-", "19990102030405", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhello", False)
    fields, block = next(archives.read_warc(archives.convert(record, "f")))
    assert block == record.block and fields["warc-record-id"] == record.identifier("f") != record.identifier("g")
    assert fields["warc-payload-digest"] == archives.sha1_label(b"hello") and fields["warc-date"] == "1999-01-02T03:04:05Z"
    fields, block = next(archives.read_warc(archives.convert(record, "f", (9, "<urn:x>"))))
    assert fields["warc-type"] == "revisit" and fields["warc-refers-to"] == "<urn:x>" and block == b"HTTP/1.0 200 OK\r\n\r\n"


def test_packed_members():
    assert archives.unpacked(gzip.compress(b"one") + gzip.compress(b"two")) == b"onetwo" and archives.unpacked(b"plain") == b"plain"


def expected(rows):
    best = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000:
            best[payload] = max(best.get(payload, page), page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        kept = best.get(payload, page)
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response" if kept == page else "revisit", None if kept == page else kept))
    return sorted(out)


def test_round_trip(spark):
    big, tricky = "é" * 700, "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nhttp://a - 20000101000000 text/html 5\n" * 30
    rows = [(1, "http://a/x y", big), (2, None, big), (3, "http://b/", None), (4, "http://b/", ""), (5, "ftp://c", "short"), (6, "http://d", "short"), (7, "u", tricky), (8, "u", tricky), (9, "", "x" * 300_000), (10, "\n", big)]
    df = local_table(spark, [(*r, "extra", 1) for r in rows], "page_id bigint, url string, html string, path string, digest int")
    for versions in ((1,), (2,), (1, 2)):
        arc = archives.write_arc(df, versions=versions, file_bytes=3000)
        back = archives.read_warc_files(spark, archives.convert_archives(spark, arc)).collect()
        assert sorted((r.source_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == expected(rows)
        assert all(r.digest_ok is not False for r in back) and len({r.identifier for r in back}) == len(rows)


def test_null_and_repeated_ids_and_empty_tables(spark, monkeypatch):
    text = "z" * 2000
    df = local_table(spark, [(None, "http://a", text), (None, "http://b", "s"), (4, "http://c", text), (4, "http://d", text)], "page_id bigint, url string, html string")
    back = archives.read_warc_files(spark, archives.convert_archives(spark, archives.write_arc(df))).collect()
    assert sorted((str(r.source_id), r.record_type, r.refers_to) for r in back) == [("4", "response", None), ("4", "revisit", 4), ("None", "response", None), ("None", "revisit", 4)]
    monkeypatch.setattr(archives, "SENT_BYTES", 0)
    again = archives.read_warc_files(spark, archives.convert_archives(spark, archives.write_arc(df))).collect()
    assert sorted(str((r.source_id, r.record_type, r.refers_to)) for r in again) == sorted(str((r.source_id, r.record_type, r.refers_to)) for r in back)
    empty = archives.write_arc(df.where("false"))
    assert archives.read_warc_files(spark, archives.convert_archives(spark, empty)).count() == 0
