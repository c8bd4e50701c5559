"""WARC archives: round trips at any range length, damage, archives in archives, repeated and odd pages."""

import gzip
import hashlib
import random
import re

import pytest

from vicinage.llm import warc

PAGES = "page_id long, url string, html string, key string, size string"


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def written(spark, rows, folder, **options):
    return warc.write_warc(warc.with_references(pages_frame(spark, rows), **options), f"file://{folder}")


def expected(rows, least=1000):
    latest = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least and i is not None:
            latest[raw] = max(latest.get(raw, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        top = latest.get(raw)
        again = i is not None and top is not None and top != i
        out.append((None if i is None else str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", str(top) if again else None))
    return sorted(out, key=str)


def found(records):
    rows = records.filter("type <> 'warcinfo'").select("key", "payload_bytes", "payload_digest", "type", "refers_to", "digest_ok").collect()
    assert all(r.digest_ok for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=str)


ODD = [
    (1, "https://a.example/x y\r\nü", "short"),
    (2, None, None),
    (3, "", ""),
    (4, "http://b.example/", "same " * 400),
    (9, "http://c.example/", "same " * 400),
    (9, "http://c.example/", "same " * 400),
    (5, "http://d.example/", "same " * 400),
    (6, "http://e.example/", "x" * 999),
    (7, "http://e.example/", "x" * 999),
    (8, "http://f.example/", "é" * 500),
    (10, "http://f.example/", "é" * 500),
    (11, "http://g.example/", "".join(chr(random.Random(7).randrange(32, 0x2000)) for _ in range(60_000))),
    (None, "http://h.example/", "same " * 400),
    (12, "http://i.example/", "WARC/1.1\r\n\r\n\x1f\x8b\x08 not a member"),
]


@pytest.mark.parametrize("split", [97, 1000, 20_000, 1 << 20])
def test_every_record_is_read_once(spark, tmp_path, split):
    files = written(spark, ODD, tmp_path)
    assert found(warc.whole_records(warc.read_warc(files, split))) == expected(ODD)


def test_archives_roll_over_and_payloads_come_back(spark, tmp_path):
    files = warc.write_warc(warc.with_references(pages_frame(spark, ODD).coalesce(1)), f"file://{tmp_path}", archive_bytes=1500)
    listed = {r.path for r in warc.archives(spark, f"file://{tmp_path}").collect()}
    assert len(listed) > 2 and {r.path.split("/")[-1] for r in files.collect()} == {p.split("/")[-1] for p in listed}
    rows = warc.read_warc(warc.archives(spark, f"file://{tmp_path}"), 500).collect()
    kept = {r.key: bytes(r.payload) for r in rows if r.type == "response"}
    assert kept["11"] == ODD[11][2].encode() and kept["3"] == b"" and kept["9"] == ("same " * 400).encode()
    assert {r.target for r in rows if r.key == "1"} == {"https://a.example/x%20y%0D%0A%C3%BC"} and {r.target for r in rows if r.key == "2"} == {None}
    for path in listed:  # any reader of gzip reads them, and each record is a member
        plain = gzip.decompress(open(path.removeprefix("file:"), "rb").read())
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and len(re.findall(rb"WARC/1.1\r\nWARC-Type: (?:response|revisit)", plain)) >= 1


def test_copies_by_a_shuffled_join(spark):
    rows = [(i, "u", "copy " * 300) for i in range(500)] + [(1000 + i, "u", f"page {i} " * 200) for i in range(50)] + ODD
    a, b = (warc.with_references(pages_frame(spark, rows), broadcast_rows=n).select("key", "refers_to").collect() for n in (10**6, 0))
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert sum(r.refers_to == 499 for r in a) == 499


def test_damage_loses_only_the_damaged_records(spark, tmp_path):
    members = [warc.record(i, None, f"page {i} ".encode() * 50) for i in range(40)]
    hurt = bytearray(members[7])
    hurt[len(hurt) // 2] ^= 255
    raw = b"junk\x1f\x8b\x08" + b"".join(members[:7]) + bytes(hurt) + b"\x1f\x8b" + b"".join(members[8:39]) + members[39][:-3]
    (tmp_path / "a.warc.gz").write_bytes(raw)
    for split in (50, 777, 1 << 20):
        rows = warc.read_warc(warc.archives(spark, f"file://{tmp_path}"), split).collect()
        assert sorted(int(r.key) for r in rows) == [*range(7), *range(8, 39)]


def test_an_archive_in_an_archive_is_one_record(spark, tmp_path):
    """The inner members are stored, not packed, so their magic bytes and headers stand in the outer member."""
    import zlib

    inner = b"".join(warc.record(1000 + i, None, bytes([65 + i]) * 300) for i in range(20))
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: %d\r\n\r\n" % len(inner)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = stored.compress(head + inner + b"\r\n\r\n") + stored.flush()
    (tmp_path / "a.warc.gz").write_bytes(warc.record(0, None, b"before") + outer + warc.record(2, None, b"after"))
    assert warc.MAGIC in outer[20:]
    for split in (64, 100, 1000, 3000, 1 << 20):
        records = warc.read_warc(warc.archives(spark, f"file://{tmp_path}"), split)
        assert sorted(r.key for r in warc.whole_records(records).collect()) == ["0", "1", "2"]


def test_foreign_headers_and_no_archives(spark, tmp_path):
    body = b"hello"
    text = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nX-Long: a\r\n b\r\nContent-Length: 5\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(text) + gzip.compress(b"no record") + gzip.compress(text.replace(b"length: 5", b"length: x").replace(b"Length: 5", b"Length: x")))
    rows = warc.read_warc(warc.archives(spark, f"file://{tmp_path}")).collect()
    assert [(r.key, r.type, r.payload_bytes, bytes(r.payload)) for r in rows] == [("urn:uuid:1", "resource", 5, body)]
    assert warc.whole_records(warc.read_warc(written(spark, [], tmp_path / "none"))).count() == 0


def test_query_equals_its_sql(spark, duck, sf_dir):
    df = warc.query(spark, sf_dir)
    want = duck.sql(warc.SQL)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


