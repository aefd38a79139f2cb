r"""WARC archives: write pages with revisit records, and read archives that may be damaged.

Records are written by Spark's text writer with the record terminator as line separator, so
commits and retries are Spark's. The reader checks every record (length, terminator, block
digest). After a failed check it looks for the next version line or gzip member from the byte
after the failed start, and logs the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import join_spread, stored
from spindrift.sources.workdir import fresh_path

VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: Digests that are checked, in hexadecimal or Base32; others are not.
ALGORITHMS = {"md5": "md5", "sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha512": "sha512", "sha-512": "sha512"}
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Record:
    start: int
    end: int
    fields: dict[str, str]
    payload: bytes


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Fields, payload and end of the record at ``at``, or what is wrong with it."""
    version = VERSION_LINE.match(data, at)
    if not version:
        return "no version line"
    # a header ends before the next version line, so damaged starts do not search the same bytes again
    next_line = _find_version(data, version.end())
    head_end = data.find(END, at, next_line)
    if head_end < 0:
        return "header is cut off" if next_line < len(data) else "no end of header"
    fields: dict[str, str] = {}
    for line in data[version.end() : head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "malformed header line"
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no content length"
    first, last = head_end + len(END), head_end + len(END) + int(length)
    if data[last : last + len(END)] != END:
        return "record does not end where its length says"
    block = data[first:last]
    if _differs(fields.get("warc-block-digest"), block):
        return "block digest differs"
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        cut = block.find(END)
        if cut < 0:
            return "no end of http header"
        payload = block[cut + len(END) :]
    if fields.get("warc-type") == "response" and _differs(fields.get("warc-payload-digest"), payload):
        return "payload digest differs"
    return fields, payload, last + len(END)


def _differs(named: str | None, data: bytes) -> bool:
    """Whether a digest, written as algorithm:value, is known and is not that of the data."""
    algorithm, _, value = (named or "").partition(":")
    if algorithm.lower() not in ALGORITHMS:
        return False
    digest = hashlib.new(ALGORITHMS[algorithm.lower()], data, usedforsecurity=False).digest()
    return value.lower() != digest.hex() and value.upper().rstrip("=") != base64.b32encode(digest).decode().rstrip("=")


def _member(data: bytes, at: int) -> tuple[list[Record | tuple[int, int, str]], int] | str:
    """Records and gaps of a gzip member, each with the place of the member, and its end."""
    inflate, parts, read = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and read < len(data):
            parts.append(inflate.decompress(data[read : read + CHUNK]))
            read = min(len(data), read + CHUNK)
    except zlib.error:
        return "damaged gzip member"
    if not inflate.eof:
        return "gzip member is cut off"
    end = read - len(inflate.unused_data)
    inner = list(salvage(b"".join(parts), packed=False))
    found = [Record(at, end, x.fields, x.payload) if isinstance(x, Record) else (at, end, x[2]) for x in inner]
    if not any(isinstance(x, Record) for x in found):
        return found[0][2] if found else "no version line"
    return found, end


def salvage(data: bytes, packed: bool = True) -> Iterator[Record | tuple[int, int, str]]:
    """Records of one archive in order, and ``(start, end, reason)`` of every quarantined gap.

    Versions 1.0 and 1.1; a gzip member (looked for if ``packed``) may hold any number of records.
    """
    at, gap, reason = 0, None, ""
    next_line = next_member = -1  # found ahead and kept, so that no stretch is searched twice
    while at < len(data):
        if packed and data.startswith(MAGIC, at):
            parsed = _member(data, at)
        else:
            parsed = parse_record(data, at)
            if not isinstance(parsed, str):
                parsed = [Record(at, parsed[2], parsed[0], parsed[1])], parsed[2]
        if not isinstance(parsed, str):
            if gap is not None:
                yield gap, at, reason
                gap = None
            yield from parsed[0]
            at = parsed[1]
            continue
        if gap is None:
            gap, reason = at, parsed
        if -1 < next_line <= at or next_line == -1:
            next_line = _find_version(data, at + 1)
        if -1 < next_member <= at or next_member == -1:
            next_member = _find(data, MAGIC, at + 1) if packed else len(data)
        at = min(next_line, next_member)
    if gap is not None:
        yield gap, len(data), reason


def _find_version(data: bytes, at: int) -> int:
    found = VERSION_LINE.search(data, at)
    return found.start() if found else len(data)


def _find(data: bytes, what: bytes, at: int) -> int:
    found = data.find(what, at)
    return len(data) if found < 0 else found


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", archive_records: int = 2000) -> None:
    """Write one record per row to archives under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is
    the response and the others are revisits of it; shorter payloads are all responses. Null html
    is an empty payload. Rows without an id are revisits if a row with an id has their payload,
    else responses; rows that repeat the response's id are responses too. A null url leaves its
    field out; control characters in urls become spaces.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.col(url_col).cast("string"), r"\p{Cntrl}", " ")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), html.alias("html"))
    long_ones = rows.select("id", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    firsts = long_ones.groupBy("sha").agg(F.count("*").alias("rows"), F.min("id").alias("first")).where("rows > 1")
    # few pages repeat another, so this is small unless the crawl is mostly copies; Spark picks the join by its size
    firsts = stored(firsts, "repeated-payloads")
    rows = join_spread(rows.withColumn("sha", F.sha2("html", 256)), firsts, "sha", "rows", ["first"], F.col("id"))
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= least_bytes), F.lit(False))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    rows = rows.select("id", "url", "sha", "first", revisit.alias("revisit"), F.octet_length("html").alias("n"), block.alias("block"))

    def field(name: str, value) -> F.Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit(VERSION.decode()),
        field("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        field("WARC-Payload-Length", F.col("n").cast("string")),
        field("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        field("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, "block").alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", archive_records).text(path)


_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, start long, end long, gap string"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _read(batches):
    names = [x.split()[0] for x in _RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for b in batches:
        for archive, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows = []
            for x in salvage(data.as_py()):
                if isinstance(x, tuple):
                    rows.append((None,) * 7 + (archive, *x))
                    continue
                f = x.fields
                revisit = f.get("warc-type") == "revisit"
                digest = f.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(x.payload).hexdigest()
                size = int(f.get("warc-payload-length", 0)) if revisit else len(x.payload)
                rows.append((_page(f.get("warc-record-id")), f.get("warc-target-uri"), f.get("warc-type"), _page(f.get("warc-refers-to")), size, digest, x.payload, archive, x.start, x.end, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives under ``path``; ``gap`` holds the reason on gap rows.

    Gap rows have ``archive``, ``start`` and ``end`` only. An archive is read by one task, so
    archives should stay well below an executor's memory, as ``write_archives`` keeps them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_read, _RECORD)


def through_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Write ``pages`` to fresh archives in the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "archives")
    write_archives(pages, path, id_col, url_col, html_col, least_bytes)
    return read_archives(pages.sparkSession, path)
