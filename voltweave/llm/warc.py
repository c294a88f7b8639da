"""WARC archives: a deduplicating writer and a salvage reader.

The writer makes one record per row, each its own gzip member. Of the rows with equal payloads that with the largest id
is a response and holds the payload; the others are revisits that refer to it. Spark's text writer stores the members, so
archives reach any file system that Spark writes to, and its commit protocol covers lost executors: a member's last byte is
0 (the high byte of its length), so 0 serves as the line separator, and what lands on disk is plain concatenated gzip.

The reader walks an archive record by record. A record passes if its gzip member inflates, its version line and headers
parse, the block has its Content-Length, the record ends as it must, and a stored payload has its SHA-1. After a failed
check the reader searches for the next place that passes - a gzip member or a version line - goes on from there, and logs
the bytes between as a quarantined gap. What a member inflates to is searched likewise, also before a break: a damaged record
costs its neighbours nothing, whether members hold one record or a whole archive.

Defined cases: a null html is the empty payload; of rows that tie for the largest id all are responses; a null id is less
than any other, and where all ids of a payload are null all its rows are responses; a null url becomes `urn:x-unknown`; an
empty table gives no archive and no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltweave.llm.common import bounded_batches, utf8
from voltweave.session import materialise, scratch_path, setting

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Payload bytes below which so many records may share an archive file; either bound keeps a file within 256 MB, unless it
#: holds one record. Files are read whole, so this bounds what a reader task holds.
FILE_RECORDS = ((1 << 17, 2000), (1 << 24, 16), (1 << 62, 1))
DATE = "2000-01-01T00:00:00Z"
LAST = b"\x00"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.md5(f"{page_id}/{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, revisit_of: int | None, revisit: bool) -> bytes:
    """An uncompressed WARC record. X-Page-Id and X-Refers-To-Page-Id are extension fields, as the format allows."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:x-unknown"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(revisit_of, digest)}", f"X-Refers-To-Page-Id: {revisit_of}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member that ends with a byte 0; a record of 16 MB or more is followed by an empty member for that."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    if out[-1:] != LAST:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        out += z.compress(b"") + z.flush()
    return out


@dataclass
class Record:
    kind: str  #: response, revisit, or gap
    start: int
    end: int
    headers: dict[str, str]
    payload_bytes: int = 0
    digest: str = ""
    payload: bytes = b""
    reason: str = ""
    inner: tuple[int, int] | None = None  #: place within what a gzip member inflates to


def _parse(b: bytes, at: int) -> tuple[Record, int]:
    """The record at a version line, and where it ends. ValueError names the failed check."""
    if not VERSION.match(b, at):
        raise ValueError("version line")
    end = b.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers")
    headers = {}
    for line in b[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("headers")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdigit():
        raise ValueError("content length")
    start, n = end + 4, int(headers["content-length"])
    if b[start + n : start + n + 4] != b"\r\n\r\n":
        raise ValueError("record end")
    block = b[start : start + n]
    http = block.find(b"\r\n\r\n")
    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block[: http + 2]) if http >= 0 else None
    if m is None:
        raise ValueError("http headers")
    record = Record(headers.get("warc-type", ""), at, start + n + 4, headers, int(m[1]), headers.get("warc-payload-digest", "").removeprefix("sha1:"))
    if record.kind == "response":
        record.payload = block[http + 4 :]
        if len(record.payload) != record.payload_bytes:
            raise ValueError("payload length")
        if base32_sha1(record.payload) != record.digest:
            raise ValueError("payload digest")
    elif record.kind != "revisit":
        raise ValueError("record type")
    return record, record.end


GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")


#: Bytes given to the inflater at once, and again where a chunk fails, to keep all that precedes the break.
CHUNK, PIECE = 1 << 16, 64


def inflate(b: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at a place inflates to, where it ends, and why it ends early, if it does.

    It is fed in chunks, so the bytes that follow a member are never copied.
    """
    z, out, i = zlib.decompressobj(31), [], at
    while i < len(b) and not z.eof:
        before = z.copy()
        try:
            out.append(z.decompress(b[i : i + CHUNK]))
            i += CHUNK
        except zlib.error:
            try:
                while True:
                    out.append(before.decompress(b[i : i + PIECE]))
                    i += PIECE
            except zlib.error:
                return b"".join(out), i, "gzip"
    if not z.eof:
        return b"".join(out), len(b), "gzip end"
    return b"".join(out), min(i, len(b)) - len(z.unused_data), ""


def _plain(b: bytes, pattern: re.Pattern) -> Iterator[Record]:
    """The records of uncompressed bytes (or of whole members where the pattern knows them), and a gap for each other stretch."""
    at, bad, why = 0, -1, ""
    while at < len(b):
        try:
            if b[at : at + 3] == GZIP and pattern is NEXT:
                records, end = _member(b, at)
            else:
                record, end = _parse(b, at)
                records = [record]
        except ValueError as e:
            if bad < 0:
                bad, why = at, str(e)
            m = pattern.search(b, at + 1)
            at = m.start() if m else len(b)
            continue
        if bad >= 0:
            yield Record("gap", bad, at, {}, reason=why)
            bad = -1
        yield from records
        at = end
    if bad >= 0:
        yield Record("gap", bad, len(b), {}, reason=why)


def _member(b: bytes, at: int) -> tuple[list[Record], int]:
    """What the gzip member at a place holds, gaps among its records included, and where it ends.

    A member that breaks off, or holds no whole record, fails if nothing in it passes. Where something does, the records
    before the break and those between damaged ones are kept, and the rest of the member is a gap.
    """
    plain, end, why = inflate(b, at)
    found = list(_plain(plain, VERSION))
    if plain and not any(r.kind != "gap" for r in found):
        raise ValueError(why or found[0].reason)
    if why and not plain:
        raise ValueError(why)
    if why:  # the next member may begin before the place where inflating failed
        m = re.compile(re.escape(GZIP)).search(b, at + 1)
        while m and m.start() < end and not _begins(b, m.start()):
            m = re.compile(re.escape(GZIP)).search(b, m.start() + 1)
        end = min(end, m.start()) if m else end
        if not found or found[-1].kind != "gap":
            found.append(Record("gap", len(plain), len(plain), {}, reason=why))
        found[-1].reason = why
    for r in found:
        r.inner, r.start, r.end = (r.start, r.end), at, end
    return found, end


def _begins(b: bytes, at: int) -> bool:
    """Whether a gzip member that starts with a record begins at a place."""
    z = zlib.decompressobj(31)
    try:
        return VERSION.match(z.decompress(b[at : at + 4096], 64)) is not None
    except zlib.error:
        return False


def salvage(b: bytes) -> Iterator[Record]:
    """The records of an archive, and a gap for each stretch of bytes in which none passes.

    Gaps within a member have the member's place and, as inner, theirs in what it inflates to.
    """
    return _plain(b, NEXT)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Writes one record per row (page_id, url, html) to archives in a folder."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), utf8(F.col("html")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))  # equal payloads are told by more than the records' SHA-1
    same = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keep"))
    same = materialise(same.where("n > 1").select(F.col("digest").alias("_digest"), "keep"), "warc-same")
    rows = rows.join(same, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))

    @F.pandas_udf("binary")
    def packed(page_id: pd.Series, url: pd.Series, payload: pd.Series, keep: pd.Series, again: pd.Series) -> pd.Series:
        whole = lambda x: None if pd.isna(x) else int(x)
        return pd.Series([member(make_record(whole(i), u, bytes(p), whole(k), bool(r)))[:-1] for i, u, p, k, r in zip(page_id, url, payload, keep, again, strict=True)], dtype=object)

    text = lambda x: F.col(x).cast("string")  # ids as text: pandas would turn nullable longs into floats
    most = pages.agg(F.max(F.octet_length(F.col("html")))).first()[0] or 0
    low = 0
    for high, together in FILE_RECORDS:
        if low <= most:
            part = rows.where((F.octet_length("payload") >= low) & (F.octet_length("payload") < high)) if most >= FILE_RECORDS[0][0] else rows
            records = part.select(packed(text("page_id"), F.col("url"), F.col("payload"), text("keep"), revisit).cast("string").alias("value"))
            records.write.mode("append").option("lineSep", LAST.decode()).option("maxRecordsPerFile", together).text(path)
        low = high


FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_start long, record_end long, inner_start long, inner_end long, reason string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, and one of type `gap` per quarantined stretch, with place and reason.

    The result is a table in the shared folder, so archives are parsed once, few of them in a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        number = lambda h, k: int(h[k]) if k in h else None
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                out = [(number(r.headers, "x-page-id"), r.headers.get("warc-target-uri"), r.payload_bytes, r.digest, r.kind, number(r.headers, "x-refers-to-page-id"), archive, r.start, r.end, *(r.inner or (None, None)), r.reason or None) for r in salvage(bytes(content))]
                found = pd.DataFrame(out, columns=names)
                yield found.astype({"page_id": "Int64", "refers_to": "Int64", "inner_start": "Int64", "inner_end": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):
        return materialise(files.select("path", "content").mapInPandas(run, FOUND), "warc-records")


def query(pages: DataFrame) -> DataFrame:
    """Writes the pages, reads them back, and fails unless as many whole records came back as went in."""
    spark = pages.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    found = read_archives(spark, path)
    back = found.agg(F.count_if(F.col("record_type") != "gap").alias("records"), F.count_if(F.col("record_type") == "gap").alias("gaps")).first()
    if (back["records"], back["gaps"]) != (rows := pages.count(), 0):
        raise RuntimeError(f"{rows} pages went into the archives, {back['records']} records and {back['gaps']} gaps came back")
    return found.where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
