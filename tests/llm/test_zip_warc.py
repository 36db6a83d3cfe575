import hashlib
import io
import struct
import zipfile

import pytest

from plumeria.llm import zip_warc as Z


def archive(records):
    data, index = b"", b""
    for i, payload in enumerate(records):
        r = Z.make_record(i, f"http://a/ü {i}\r\nX: y", payload, None, len(payload), hashlib.sha1(payload).hexdigest())
        index += b'{"id": %d, "offset": %d, "length": %d}\n' % (i, len(data), len(r))
        data += r
    return Z.pack_archive(data, index)


PAYLOADS = [b"", b"x" * 10, b"\r\n\r\n\x00\xff" * 500, "é漢".encode()]


def read(content):
    return list(Z.read_records(Z.Ranges(io.BytesIO(content), len(content))))


def test_records_survive():
    got = read(archive(PAYLOADS))
    assert [p for *_, p in got] == PAYLOADS
    assert [Z.page_of(w["warc-record-id"]) for w, *_ in got] == list(range(4))
    assert all("x" not in w for w, *_ in got)  # a line break in a URL makes no header


def test_the_archive_is_a_zip_of_stored_members():
    with zipfile.ZipFile(io.BytesIO(archive(PAYLOADS))) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


@pytest.mark.parametrize("before,note", [(b"", b""), (b"junk", b""), (b"", b"a note PK\5\6 in the end"), (b"#!stub\n", b"n" * 65000)])
def test_prefix_and_comment(before, note):
    content = archive(PAYLOADS)
    content = before + content[:-2] + struct.pack("<H", len(note)) + note
    assert [p for *_, p in read(content)] == PAYLOADS


def test_zip64_end_record():
    content = archive(PAYLOADS)
    end = content.rfind(b"PK\5\6")
    entries, size, start = struct.unpack_from("<HII", content, end + 10)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, entries, entries, size, start)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert [p for *_, p in read(content[:end] + end64 + locator + tail)] == PAYLOADS


def test_zip64_entries():
    """Sizes and offsets of the directory moved to the 64-bit extra field."""
    content = archive(PAYLOADS)
    members = list(Z.directory(Z.Ranges(io.BytesIO(content), len(content))))
    first = content.find(b"PK\1\2")
    made = b""
    for name, method, size, offset in members:
        extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
        made += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, method, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name.encode() + extra
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 2, 2, len(made), first, 0)
    moved = content[:first] + made + end
    assert list(Z.directory(Z.Ranges(io.BytesIO(moved), len(moved)))) == members
    assert [p for *_, p in read(moved)] == PAYLOADS


@pytest.mark.parametrize("content", [b"", b"PK", b"no zip at all" * 10, archive([b"a"])[:-30]])
def test_broken_archives_are_refused(content):
    with pytest.raises((ValueError, struct.error)):
        read(content)


def brute(rows):
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 1000 and i is not None:
            first[p] = max(first.get(p, i), i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        to = first.get(p) if first.get(p) != i else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_round_trip_against_brute_force(spark, sf_dir, monkeypatch):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a", big), (5, None, big), (3, "u", big), (None, "u", big), (5, "again", big), (7, "", None), (8, "x", ""), (9, "x", "same"), (10, "x", "same"), (2**53 + 1, "x", "y" * 1000), (2**53 + 3, "x", "y" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS sha1", "1 AS n")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = Z.archive_round_trip(pages)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == brute(rows)
    monkeypatch.setattr(Z, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, Z.archive_round_trip(pages).select(*columns).collect()), key=repr) == brute(rows)
    assert Z.archive_round_trip(pages.limit(0)).count() == 0
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = sorted(map(tuple, Z.archive_round_trip(table).select(*columns).collect()), key=repr)
    assert got == brute([(r.page_id, r.url, r.html) for r in table.collect()])
