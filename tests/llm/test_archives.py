"""WARC writing, reading and assembly: brute force, exact round trips, foreign archives."""

import base64
import gzip
import hashlib
from collections import Counter

import pytest

from turfline.llm import queries, warc
from turfline.llm.store import shared_path

SCHEMA = "page_id long, url string, html string, row int, size string, digest string, payload int, _part int, file string"
GAP = "\r\n\r\n"


def pages():
    tricky = ["", None, "x", GAP, GAP + "\r\n", "\r\n", "\r", "a\r\n\r", f"a\r\n\r\r\n\r\nb{GAP}{GAP}", "é" * 5000 + GAP + "end",
              f"quoted{GAP}WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3{GAP}abc{GAP}", "<html>" + "long " * 400_000 + "\r\n", "x", "x"]
    rows = [(i, f"https://h{i % 3}.example.org/p/{i}?q=1#top", t) for i, t in enumerate(tricky)]
    rows += [(100 + i, "https://hot.example.org/", "the same page") for i in range(40)]
    rows += [(7, None, "same id, no url"), (7, "http://a\r\nWARC-Type: x", "same id"), (None, "http://n/", "no id"), (None, None, "x"),
             (50, "http://r/", "repeated"), (50, "http://r/", "repeated")]
    return [(*r, 1, "clash", "clash", 2, 3, "clash") for r in rows]


def expected(rows):
    out, groups = [], {}
    for r in rows:
        groups.setdefault((r[2] or "").encode(), []).append(r)
    for raw, same in groups.items():
        code = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        ids = sorted((r[0] for r in same), key=lambda i: -1 if i is None else i)
        out += [(i, len(raw), code, "revisit", ids[-1]) for i in ids[:-1]] + [(ids[-1], len(raw), code, "response", None)]
    return Counter(out)


@pytest.fixture(scope="module")
def written(spark):
    path = shared_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(3), path)
    return path


def test_report_equals_brute_force(spark, written):
    got = warc.page_report(warc.assemble(warc.read_records(spark, written)))
    assert Counter(map(tuple, got.collect())) == expected(pages())


def test_payloads_and_requests_come_back(spark, written):
    captures = warc.assemble(warc.read_records(spark, written)).collect()
    assert len(captures) == len(pages())
    sent = Counter((r[2] or "").encode() for r in pages())
    assert {bytes(c.response.payload) for c in captures if c.warc_type == "response"} == set(sent)
    assert all(c.request is not None and len(c.metadata) == 1 for c in captures)
    by_url = {c.target_uri: c for c in captures}
    assert by_url["https://h1.example.org/p/4?q=1#top"].request.http["host"] == "h1.example.org"
    assert "http://a%0D%0AWARC-Type: x" in by_url and None in by_url


def test_files_are_archives(spark, written):
    """An independent reader of the gzipped bytes finds as many records, each with its stated length."""
    files = [r.path for r in spark.read.format("binaryFile").load(written).select("path").collect()]
    kinds = Counter()
    for file in files:
        raw = gzip.open(file.removeprefix("file:"), "rb").read()
        while raw:
            head, _, raw = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            length = int(fields[b"Content-Length"])
            assert raw[length:length + 4] == b"\r\n\r\n"
            raw, kinds[fields[b"WARC-Type"].decode()] = raw[length + 4:], kinds[fields[b"WARC-Type"].decode()] + 1
    distinct = len({r[2] or "" for r in pages()})
    assert kinds == {"request": len(pages()), "metadata": len(pages()), "response": distinct, "revisit": len(pages()) - distinct}


def test_small_payloads_are_all_responses(spark):
    path = shared_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
                                              "page_id long, url string, html string"), path, least=3)
    got = warc.page_report(warc.assemble(warc.read_records(spark, path)))
    assert {(r.page_id, r.record_type, r.refers_to) for r in got.collect()} == {
        (1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)}


def test_empty_table(spark):
    path = shared_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_report(warc.assemble(warc.read_records(spark, path))).count() == 0


def record(kind, rid, block, *headers, kind_of="application/http"):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"Content-Type: {kind_of}", *headers, f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + GAP).encode() + block + GAP.encode()


def test_foreign_archive_in_splits(spark, tmp_path):
    """Unpacked archive, cut by Spark into many splits: links in both directions and over two steps,
    binary payloads, repeated fields, a folded header, junk between records, a record cut off."""
    blob = bytes(range(256)) * 40
    body = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n"
    raw = record("warcinfo", "<i>", b"software: x\r\n", kind_of="application/warc-fields")
    for i in range(60):
        raw += record("request", f"<q{i}>", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n")
        raw += record("response", f"<r{i}>", body + blob + str(i).encode(), f"WARC-Concurrent-To: <q{i}>", "X-Long: a\r\n b")
        raw += record("metadata", f"<m{i}>", b"outlink: a\r\noutlink: b\r\n", f"WARC-Concurrent-To: <q{i}>", kind_of="application/warc-fields")
        raw += b"junk" + GAP.encode()
    raw += record("metadata", "<lost>", b"a: b\r\n", "WARC-Concurrent-To: <nothing>", kind_of="application/warc-fields")
    raw += record("response", "<cut>", body + blob)[:-2000]
    (tmp_path / "one.warc").write_bytes(raw)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = warc.read_records(spark, str(tmp_path / "one.warc"), whole_files=False)
        captures = {c.capture: c for c in warc.assemble(records).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert set(captures) == {f"<r{i}>" for i in range(60)}
    for i in range(60):
        c = captures[f"<r{i}>"]
        assert bytes(c.response.payload) == blob + str(i).encode() and c.response.http["server"] == "s"
        assert c.request.http["host"] == "a"
        assert [[tuple(f) for f in m] for m in c.metadata] == [[("outlink", "a"), ("outlink", "b")]]


def test_query_reads_all_pages(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_warc_captures(spark, sf)
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert Counter(map(tuple, got.collect())) == expected(rows)
