"""Archives: the ZIP64 directory by hand, damaged files, and pages of hot payloads."""

import struct

import pytest
from pyspark.sql import functions as F

from quillspark.llm import archives


def zip64(names, bodies, comment=b"", end_at_64=True):
    """An archive of stored members whose sizes and offsets stand in ZIP64 extra fields, with a ZIP64 end record and its locator."""
    out, entries = b"", b""
    for name, body in zip(names, bodies, strict=True):
        at, raw = len(out), name.encode()
        out += b"PK\x03\x04" + struct.pack("<5H3L2H", 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, len(body), len(body)) + body
        extra = struct.pack("<2HL", 0x5455, 4, 0) + struct.pack("<2H3Q", 1, 24, len(body), len(body), at)
        entries += b"PK\x01\x02" + struct.pack("<6H3L5H2L", 45, 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 3, 0, 0, 0, 0xFFFFFFFF) + raw + extra + b"own"
    start = len(out)
    out += entries
    end64 = len(out)
    out += b"PK\x06\x06" + struct.pack("<Q2H2L4Q", 44, 45, 45, 0, 0, len(names), len(names), len(entries), start)
    out += b"PK\x06\x07" + struct.pack("<LQL", 0, end64, 1)
    return out + b"PK\x05\x06" + struct.pack("<4H2LH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment


def reader(data, asked=None):
    def read(offset, n):
        if asked is not None:
            asked.append((offset, n))
        return data[offset : offset + n]

    return read


def test_zip64_directory():
    bodies = [b"hello", b"", b"x" * 200_000]
    data = zip64(["a", "ordner/é", "big"], bodies, b"a comment")
    asked = []
    d = archives.ZipDirectory(reader(data, asked), len(data))
    assert [m.size for m in d.members.values()] == [5, 0, 200_000]
    for name, body in zip(d.members, bodies, strict=True):
        at = d.data_offset(name)
        assert data[at : at + d.members[name].size] == body
    assert sum(n for _, n in asked) < 100_000  # members are not read whole


@pytest.mark.parametrize("damage", [lambda d: d[:-30], lambda d: b"", lambda d: d.replace(b"PK\x06\x06", b"xxxx"), lambda d: d.replace(b"PK\x01\x02", b"xxxx")])
def test_damaged_directories(damage):
    data = damage(zip64(["a"], [b"hello"]))
    with pytest.raises(ValueError):
        archives.ZipDirectory(reader(data), len(data))


def test_damaged_records():
    whole = archives.record(1, "u", b"payload", None, "response")
    assert archives.parse_record(whole)["payload"] == b"payload"
    for broken in (whole[:-9], whole.replace(b"payload\r\n", b"paXload\r\n"), whole.replace(b"WARC/1.1", b"none")):
        with pytest.raises(ValueError):
            archives.parse_record(broken)


@pytest.mark.parametrize("hot", [1000, 2])
def test_round_trip(spark, monkeypatch, hot):
    monkeypatch.setattr(archives, "HOT_ROWS", hot)
    texts = [None, "", "same"] * 9 + ["é", "x" * 100_000, "same", "one\r\n\r\ntwo", "last"]
    rows = [(i if i % 7 else None, f"http://h/{i}\n", t, i, "d") for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, salt int, digest string")
    got = archives.archive_round_trip(pages).collect()
    keeper = {}
    for i, _, t, *_ in rows:
        keeper[t or ""] = max(keeper.get(t or "", -1), -1 if i is None else i)
    want = []
    for i, _, t, *_ in rows:
        t = t or ""
        own = (-1 if i is None else i) == keeper[t]
        want.append((str(i), len(t.encode()), archives.payload_digest(t.encode()), "response" if own else "revisit", None if own else keeper[t], t.encode() if own else None))
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)
    assert archives.archive_round_trip(pages.limit(0)).count() == 0
    small = archives.archive_round_trip(pages, min_payload=5).where(F.col("payload_bytes") < 5)
    assert {r.record_type for r in small.collect()} == {"response"}
