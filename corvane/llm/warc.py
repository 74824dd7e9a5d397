"""WARC archives: a writer with revisit records and a reader that salvages damaged files."""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Steps, if_small, no_text, scratch, written

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PAGE = "urn:page:"
#: Bytes in one archive (more only if one record has more); the reader holds one archive at a time.
MOST_BYTES = 32_000_000
#: Bytes fed to the inflater at once.
FED = 1 << 16
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1 of a payload."""
    return b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record without its closing line breaks: a response, or a revisit of another page's."""
    block = HTTP + (payload if refers_to is None else b"")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{PAGE}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Refers-To", None if refers_to is None else f"<{PAGE}{refers_to}>"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block


@dataclass
class Record:
    """A record found at `start` up to `end` of an archive (of its compressed member, if it is one)."""

    start: int
    end: int
    headers: dict[str, str] = field(repr=False)
    payload: bytes = field(repr=False)


@dataclass
class Gap:
    """Bytes from `start` up to `end` that no valid record covers, and what failed first there."""

    start: int
    end: int
    reason: str


class _Bad(ValueError):
    pass


def _parsed(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record whose version line is at `start`; all checks made."""
    top = data.find(END, start)
    if top < 0:
        raise _Bad("no end of headers")
    lines = data[start:top].split(b"\r\n")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("header without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        raise _Bad("no length or type")
    begin = top + len(END)
    end = begin + int(headers["content-length"])
    if end + len(END) > len(data):
        raise _Bad("truncated")
    if data[end : end + len(END)] != END:
        raise _Bad("no record end where the length says")
    block = data[begin:end]
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise _Bad("block digest differs")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(END)[2]
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest", f"sha1:{digest(payload)}") != f"sha1:{digest(payload)}":
        raise _Bad("payload digest differs")
    return headers, payload, end + len(END)


def _member(data: memoryview, start: int) -> tuple[bytes, int]:
    """What the gzip member at `start` holds, and where it ends; nothing behind it is copied."""
    inflate, at, parts = zlib.decompressobj(31), start, []
    try:
        while not inflate.eof and at < len(data):
            parts.append(inflate.decompress(data[at : at + FED]))
            at += FED
            if parts[0] and not parts[0].startswith(b"WARC/1."[: len(parts[0])]):
                raise _Bad("member holds no record")
    except zlib.error as e:
        raise _Bad(f"member: {e}") from None
    if not inflate.eof:
        raise _Bad("member is truncated")
    return b"".join(parts), min(at, len(data)) - len(inflate.unused_data)


def salvaged(data: bytes) -> Iterator[Record | Gap]:
    """Every valid record of an archive, and the gaps between them, in order.

    Records stand in the file as they are or as gzip members of their own. Where
    a check fails (framing, lengths, digests, inflation) the search goes on with
    the next gzip member or version line after the failed one; bytes up to the
    next valid record are one gap. An empty file has neither. The time grows with
    the bytes, not with members times bytes.
    """
    at, gap, view = 0, None, memoryview(data)
    while at < len(data):
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                member, end = _member(view, at)
                headers, payload, used = _parsed(member, 0)
                if used != len(member):
                    raise _Bad("member holds more than a record")
            elif _NEXT.match(data, at):
                headers, payload, end = _parsed(data, at)
            else:
                raise _Bad("no version line")
        except _Bad as e:
            gap = gap or (at, str(e))
            found = _NEXT.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap:
            yield Gap(gap[0], at, gap[1])
            gap = None
        yield Record(at, end, headers, payload)
        at = end
    if gap:
        yield Gap(gap[0], len(data), gap[1])


def _recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole archives, as many records as come to MOST_BYTES in each, without the last one's closing line breaks."""
    records, size = [], 0
    archive = lambda: pa.RecordBatch.from_arrays([pa.array([END.join(records).decode()], pa.large_string())], ["value"])
    for batch in batches:
        for i, u, h, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one = record(i, u, (h or "").encode(), r)
            if records and size + len(one) > MOST_BYTES:
                yield archive()
                records, size = [], 0
            records.append(one)
            size += len(one) + len(END)
    if records:
        yield archive()


def archived(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write one record for each row (page_id, url, html) to plain WARC files below `path`.

    Of pages with equal payloads of `least_bytes` or more the one with the largest
    id is a response and the others revisit it; a page with a null id is a
    response and is not revisited. Rows that share an id are judged by their own
    payloads; equal rows with the largest id are all responses. Null html is an
    empty payload. Digests are compared, not payloads; the pages themselves are
    not shuffled unless more than half a million of them are revisits. An archive
    is one row of Spark's committed writer, so a lost executor leaves no half
    record behind.
    """
    html = no_text(F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    able = rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least_bytes)).select("page_id", "sha1")
    with Steps(pages.sparkSession, "warc") as steps:
        able = steps.written(able, "digests")
        first = able.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
        again = steps.written(able.join(first, "sha1").where("page_id < refers_to").distinct(), "revisits")
        records = rows.join(if_small(again), ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to").mapInArrow(_recorded, "value string")
        records.write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).text(path)


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "start", "end", "reason", "type", "record_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                file, data, rows, held = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), [], 0
                for x in salvaged(data):
                    held += len(x.payload) if payloads and isinstance(x, Record) else 0
                    if isinstance(x, Gap):
                        rows.append((file, x.start, x.end, x.reason, *[None] * 7))
                    else:
                        h = x.headers
                        length = int(h["x-payload-length"]) if h["warc-type"] == "revisit" and h.get("x-payload-length", "").isdigit() else len(x.payload)
                        told = h.get("warc-payload-digest", "").removeprefix("sha1:") if h["warc-type"] == "revisit" else digest(x.payload)
                        rows.append((file, x.start, x.end, None, h["warc-type"], h.get("warc-record-id"), h.get("warc-target-uri"), length, told, h.get("warc-refers-to"), x.payload if payloads else None))
                    if len(rows) == 1000 or held > FED * 256:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below `path`: reason is null for a record.

    file, start, end, reason, type, record_id, url, payload_bytes,
    payload_digest, refers_to and payload (null unless asked for). Digests and
    lengths are those of the bytes read; for a revisit, which has none, they are
    those its headers give. One archive is one row of Spark's reader for binary
    files, so a task holds one archive at a time; that reader takes files of 2 GB
    at most and fails on larger ones.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "file string, start long, end long, reason string, type string, record_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    return files.mapInArrow(_read(payloads), schema)


def quarantined(found: DataFrame, path: str) -> DataFrame:
    """The gaps (file, start, end, reason) among what `read` found, written as a table to `path`."""
    gaps = found.where("reason IS NOT NULL").select("file", "start", "end", "reason")
    gaps.write.parquet(path)
    return found.sparkSession.read.schema(gaps.schema).parquet(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back.

    Archives, what was read and the log of gaps stay in the shared folder.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    archived(pages, path)
    found = written(read(spark, path, payloads=False), "records")
    quarantined(found, scratch(spark, "quarantine"))
    number = lambda c: F.expr("try_cast(nullif(substring({0}, {1}, length({0}) - {1}), '') as bigint)".format(c, len(PAGE) + 2))
    return found.where("reason IS NULL").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
