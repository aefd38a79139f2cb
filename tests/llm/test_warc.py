"""Archives: round trip, revisits and recovery of damaged files."""

import base64
import gzip
import hashlib

import pytest

from spindrift.llm import warc

PAGES = "page_id long, url string, html string"


def record(body: bytes, page: int = 1) -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def read(data):
    found = list(warc.salvage(data))
    return [x.payload for x in found if isinstance(x, warc.Record)], [x[:2] for x in found if isinstance(x, tuple)]


BODIES = [b"one", b"", b"WARC/1.1\r\nnot a record", b"\x1f\x8b\x08 not a member", b"x" * 200_000, b"\r\n\r\n"]


@pytest.mark.parametrize("pack", [lambda r: r, gzip.compress])
def test_whole_archives(pack):
    assert read(b"".join(pack(record(b)) for b in BODIES)) == (BODIES, [])
    assert read(b"") == ([], [])


@pytest.mark.parametrize("pack", [lambda r: r, gzip.compress])
def test_later_records_are_recovered_and_gaps_are_logged(pack):
    parts = [pack(record(b, i)) for i, b in enumerate([b"first " * 40, b"second " * 40, b"third " * 40])]
    start, end = len(parts[0]), len(parts[0]) + len(parts[1])
    whole = b"".join(parts)
    flipped = bytearray(whole)
    flipped[end - 20] ^= 0xFF
    kept = [b"first " * 40, b"third " * 40]
    assert read(bytes(flipped)) == (kept, [(start, end)])
    assert read(whole[: start + 30] + whole[end:]) == (kept, [(start, start + 30)])
    junk = parts[0] + b"WARC/1.1\r\nbroken\r\n\r\n" * 3 + parts[2]
    assert read(junk) == (kept, [(start, len(junk) - len(parts[2]))])
    cut = whole[:-10]
    assert read(cut) == ([b"first " * 40, b"second " * 40], [(end, len(cut))])


def test_a_wrong_length_does_not_swallow_the_next_record():
    bad = record(b"body").replace(b"Content-Length: 4", b"Content-Length: 900")
    assert read(bad + record(b"next")) == ([b"next"], [(0, len(bad))])


def test_pages_through_archives(spark, rows):
    long = "<p>é" + "x" * 200
    data = [(5, "http://a/\r\nX: 1", long), (3, None, long), (9, "u", long), (4, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", long), (3, "again", long), (11, "u", "WARC/1.1\r\n\r\n" + long), (12, "u", "y" * 3_000_000)]
    frame = spark.createDataFrame([(*r, "x") for r in data], PAGES + ", payload string").repartition(3)
    expected = []
    for i, _, html in data:
        raw = (html or "").encode()
        first = min((j for j, _, h in data if (h or "") == (html or "") and j is not None), default=None)
        revisit = len(raw) >= 100 and i != first
        expected.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    got = warc.through_archives(frame)
    assert got.where("gap is not null").count() == 0
    assert rows(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == sorted(expected, key=str)
    bodies = {(r.page_id, r.record_type): bytes(r.payload) for r in got.collect()}
    assert bodies[11, "response"].decode() == "WARC/1.1\r\n\r\n" + long and bodies[9, "revisit"] == b""
    assert rows(warc.through_archives(frame.limit(0))) == []


def test_a_damaged_archive_is_read_by_spark(spark, tmp_path):
    parts = [record(bytes([65 + i]) * 500, i) for i in range(4)]
    data = bytearray(b"".join(parts))
    data[len(parts[0]) + len(parts[1]) - 50] ^= 1
    (tmp_path / "a.warc").write_bytes(bytes(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in got if r.gap is None) == sorted([0, 2, 3, 0, 1, 2, 3])
    assert [(r.start, r.end, r.gap) for r in got if r.gap] == [(len(parts[0]), len(parts[0]) + len(parts[1]), "block digest differs")]


def test_a_header_may_be_long(spark):
    url = "data:," + "x" * 100_000
    data = [(1, url, "y" * 200), (2, "u", "y" * 200)]
    got = warc.through_archives(spark.createDataFrame(data, PAGES)).orderBy("page_id").collect()
    assert [(r.page_id, r.url, r.record_type, r.refers_to, r.gap) for r in got] == [(1, url, "response", None, None), (2, "u", "revisit", 1, None)]


def test_a_cut_header_ends_at_the_next_version_line():
    bad = b"WARC/1.1\r\nWARC-Target-URI: " + b"x" * 100_000
    assert read(bad + record(b"next")) == ([b"next"], [(0, len(bad))])


def test_records_of_other_writers():
    def with_digest(body, digest):
        return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Block-Digest: {digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    sha1 = base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    good = with_digest(b"one", f"sha1:{sha1}") + with_digest(b"two", "blake3:00") + record(b"three")
    bad = with_digest(b"One", f"sha1:{sha1}")
    bodies = [b"one", b"two", b"three"]
    assert read(good) == read(gzip.compress(good)) == (bodies, [])
    assert read(good + bad) == (bodies, [(len(good), len(good) + len(bad))])
    whole = gzip.compress(good + bad)
    assert read(whole) == (bodies, [(0, len(whole))])
