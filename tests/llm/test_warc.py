"""Archive formats, conversion, and what the archives hold."""

from __future__ import annotations

import gzip
import hashlib

import pytest

from rasterloom.llm import warc

PAGES = "page_id long, url string, html string, id int"


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_round_trip(version):
    blocks = [b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + b"body\n\nfiledesc://x 1 2 3 4\n", b"plain", b""]
    raw = warc.arc_version_block(version, "a.arc", warc.DATE) + b"".join(warc.arc_record(version, f"http://x/{i} y", warc.DATE, b) for i, b in enumerate(blocks))
    for data in (raw, gzip.compress(raw)):
        got = list(warc.read_arc(data))
        assert [r.block for r in got] == blocks and {r.version for r in got} == {version}
        assert got[1].fields["URL"] == "http://x/1%20y" and got[0].http[1] == blocks[0].split(b"\r\n\r\n", 1)[1]
    if version == "2":
        assert got[0].fields["Result-code"] == "200" and got[0].fields["Checksum"] == hashlib.sha256(blocks[0]).hexdigest()


def test_urls_with_blanks_and_short_records():
    raw = warc.arc_version_block("1", "a", warc.DATE) + b"http://x/a b 1.2.3.4 20200102030405 text/html 4\nabcd\n"
    (r,) = warc.read_arc(raw)
    assert r.fields["URL"] == "http://x/a b" and r.block == b"abcd"
    with pytest.raises(ValueError, match="declares"):
        list(warc.read_arc(raw[:-3]))
    with pytest.raises(ValueError, match="fields"):
        list(warc.read_arc(warc.arc_version_block("1", "a", warc.DATE) + b"http://x 4\nabcd\n"))


def test_conversion():
    raw = warc.arc_version_block("1", "a", warc.DATE) + warc.arc_record("1", "http://x/", "20200102030405", b"HTTP/1.1 200 OK\r\n\r\npage") + warc.arc_record("1", "dns:x", "20200102030405", b"1.2.3.4")
    info, page, dns = warc.read_warc(warc.convert(raw))
    assert info.headers["WARC-Type"] == "warcinfo"
    assert page.headers["WARC-Type"] == "response" and page.headers["WARC-Date"] == "2020-01-02T03:04:05Z" and page.headers["WARC-Target-URI"] == "http://x/"
    assert page.headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"page").hexdigest() and page.block.endswith(b"\r\n\r\npage")
    assert dns.headers["WARC-Type"] == "resource" and dns.block == b"1.2.3.4"
    assert warc.convert(raw) == warc.convert(raw)


def test_pages(spark):
    same, long = "x" * 100, "é" * 60
    rows = [(d, f"http://h/{d}", f"<p>{d}</p>") for d in range(40)]
    rows += [(100, "u", same), (50, "u\nv w", same), (101, None, same), (102, "u", same[:-1]), (103, "u", same[:-1]), (104, "u", None), (105, "u", ""), (106, "a", long), (107, "b", long), (None, "n", "null id"), (108, "u", "WARC/1.1\r\n\r\n" * 20)]
    rows += [(200, "u", "twice " * 30), (200, "u", "twice " * 30)]
    d = spark.createDataFrame([(*r, 1) for r in rows], PAGES)
    got = warc.archive_pages(d, per_file=7).collect()
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h or ""] != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    want[-1] = (200, 180, want[-1][2], "revisit", 200)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_alike_rows_and_long_pages_are_spread_over_archives(spark, monkeypatch):
    from rasterloom.llm import common

    monkeypatch.setattr(warc, "ARC_BYTES", 200_000)
    rows = [(1, "u", "alike " * 30, 1)] * 60 + [(2, "u", "long " * 200_000, 1)]
    folder = common.fresh_dir(spark, "arc")
    index = warc.write_arcs(spark.createDataFrame(rows, PAGES).repartition(3), folder, per_file=10)
    counts = [r["count"] for r in index.groupBy("arc").count().collect()]
    assert len(counts) >= 5 and max(counts) <= 20
    files = warc.convert_arcs(index, folder)
    assert files.count() == len(counts)
    got = warc.read_warcs(files).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"]) for r in got) == sorted([(1, 180, "response")] + [(1, 180, "revisit")] * 59 + [(2, 1_000_000, "response")])


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0
