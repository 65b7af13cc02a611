from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from factloom.llm import archives as A
from factloom.session import scratch_path


def test_versions_and_damage():
    block = A.http_block(7, b"<p>\nnew line</p>")
    for version in (1, 2):
        start = A.arc_start(version, "x.arc", "20240101000000")
        record = A.arc_header(version, "http://a/ b", "199901020304", "text/html", len(block), filename="x.arc", offset=0) + block + b"\n"
        data = start + record + b"garbage line\n" + record + A.arc_header(version, "http://cut", "20240101000000", "text/html", 99_999, filename="x", offset=0) + b"short"
        found = [A.synthesise(r) for r in A.parse_arc(data)]
        assert [f["kind"] for f in found] == ["warcinfo", "response", "response"]
        assert found[1]["payload"] == b"<p>\nnew line</p>" and found[1]["page_id"] == 7 and found[1]["date"] == "1999-01-02T03:04:00Z" and found[1]["uri"] == "http://a/ b"
        assert found[1]["id"] != found[2]["id"] and found[1]["digest"] == found[2]["digest"]
    assert A.synthesise(A.ArcRecord(0, {"uri": "dns:a", "ip": "0", "date": "20240101000000", "mime": "text/dns"}, b"a 1 IN A 1.2.3.4"))["kind"] == "resource"


def test_numbers_are_ascii_and_members_can_be_cut():
    import gzip

    block = A.http_block(1, b"payload")
    record = lambda n: A.arc_header(1, f"http://a/{n}", "20240101000000", "text/html", len(block), filename="x", offset=0) + block + b"\n"
    odd = "http://a 0.0.0.0 20240101000000 text/html ²\nhttp://a 0.0.0.0 ２０２４ text/html 5\nhttp://a 0.0.0.0 20240101000000 t 99999999999999999999999999\n".encode()
    start = A.arc_start(1, "x.arc", "20240101000000")
    assert [r.fields["uri"] for r in A.parse_arc(start + odd + record(1))][1:] == ["http://a/1"]
    members = [gzip.compress(x) for x in (start, record(1), record(2), record(3))]
    uris = lambda data: [r.fields["uri"] for r in A.records_of(data)][1:]
    assert uris(b"".join(members)) == ["http://a/1", "http://a/2", "http://a/3"] == uris(start + record(1) + record(2) + record(3))
    assert uris(members[0] + members[1] + members[2][:-20] + members[3]) == ["http://a/1", "http://a/3"]
    assert uris(members[0] + members[1] + members[2][:30]) == ["http://a/1"]
    broken = bytearray(members[2])
    broken[14] ^= 0xFF
    assert "http://a/3" in uris(members[0] + members[1] + bytes(broken) + members[3])
    latin = "http://a/é 0.0.0.0 20240101000000 text/html 3\nabc\n".encode("latin-1")
    assert [r.fields["uri"] for r in A.parse_arc(start + latin)][1:] == ["http://a/%E9"]
    assert list(A.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")) == [] == list(A.parse_warc(b"WARC/1.1\r\nno end"))


def test_foreign_archives_of_any_bytes(spark, tmp_path, monkeypatch):
    """Versions 1 and 2, Latin-1 and an image, compressed or not, under names of their own."""
    import gzip
    import hashlib

    latin, image = "caf\u00e9 ".encode("latin-1") * 40, bytes(range(256)) * 4
    payloads = {"http://l/": latin, "http://i/": image, "http://again/": image}
    for version, name, pack in ((1, "IAH-2001.arc.gz", gzip.compress), (2, "crawl.arc", lambda x: x)):
        data = A.arc_start(version, name, "20010101000000")
        for uri, payload in payloads.items():
            block = b"HTTP/1.0 200 OK\r\nContent-Type: x/y\r\n\r\n" + payload
            data += A.arc_header(version, uri, "20010203040506", "x/y", len(block), filename=name, offset=0) + block + b"\n"
        (tmp_path / name).write_bytes(pack(data))
    (tmp_path / "empty.arc").write_bytes(b"")
    for limit in (16 << 20, 0):  # revisits sent to the files, and both dealt by path
        monkeypatch.setattr(A, "BROADCAST_BYTES", limit)
        warc = scratch_path(spark, "warc")
        A.convert(spark, str(tmp_path), warc)
        out = A.resolve(A.read_warc(spark, warc)).collect()
        digests = {u: hashlib.sha256(p).hexdigest() for u, p in payloads.items()}
        assert sorted(r.payload_digest for r in out) == sorted([*digests.values()] * 2)
        assert sorted(r.record_type for r in out) == ["response"] * 2 + ["revisit"] * 4
        assert {r.payload_bytes for r in out} == {len(latin), len(image)}


def test_against_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(str, con.sql(A.ORACLE).fetchall())) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in A.op9_legacy_archives(spark, sf).collect())


def round_trip(spark, rows, tmp=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, payload string").withColumn("date", F.lit("20240101000000")).withColumn("path", F.lit("clash"))
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    A.write_arc(pages, arc)
    A.convert(spark, arc, warc)
    return A.resolve(A.read_warc(spark, warc)).collect()


def test_odd_input(spark, monkeypatch):
    big = "é\r\n\r\nWARC/1.1\r\n" * 30
    rows = [(5, "http://a", big), (3, "http://b c\n", big), (None, None, big), (4, "", None), (6, "http://e", ""), (3, "http://b", big), (9, "http://long", "y" * 3_000_000)]
    out = round_trip(spark, rows)
    assert len(out) == len(rows)
    assert sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes) for r in out if r.payload_bytes == len(big.encode())) == [(-1, "revisit", 3, 480), (3, "response", None, 480), (3, "revisit", 3, 480), (5, "revisit", 3, 480)]
    assert sum(r.record_type == "response" and r.payload_bytes == 0 for r in out) == 2
    assert round_trip(spark, rows[:0] or []) == []
