"""Media columns: what bytes are, told by signatures and confirmed by their structure.

An Aho-Corasick automaton finds every magic number in one pass over the bytes; a validator for each format then walks the
structure (chunks, blocks, pages, checksums, lengths) and gives the object's length, or rejects the place. The object at
offset 0 corrects the declared type; objects further in are carved, the leftmost first and never overlapping. A stretch
that no validator confirms stays `application/octet-stream`.

`pack` stores bytes losslessly as 8-bit mono samples of a WAV file, padded with bytes 0 to a positive multiple of 64;
`unpack` finds and validates the WAV and returns its samples.

Defined cases: a null text counts as empty and is stored as 64 zero bytes; equal bytes give equal values; other columns are
not looked at. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltweave.llm.common import bounded_batches, utf8

UNIT = 64
RATE = 8000
UNKNOWN = "application/octet-stream"


def _png(b: bytes, at: int) -> int | None:
    i = at + 8
    first = True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or (first and kind != b"IHDR"):
            return None
        if zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return None
        i += 12 + n
        first = False
        if kind == b"IEND":
            return i - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while i < len(b):
        mark = b[i]
        if mark == 0x3B:
            return i + 1 - at
        if mark == 0x21:
            i += 2
        elif mark == 0x2C and i + 10 <= len(b):
            local = b[i + 9]
            i += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
        else:
            return None
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        mark = b[i + 1]
        if mark == 0xD9:
            return i + 2 - at
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2:
            return None
        i += 2 + n
        if mark == 0xDA:  # entropy-coded data ends at a marker other than a stuffed byte or restart
            m = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]", re.DOTALL).search(b, i)
            if m is None:
                return None
            i = m.start()
    return i + 2 - at if b[i : i + 2] == b"\xff\xd9" else None


def _riff(b: bytes, at: int) -> int | None:
    if at + 12 > len(b):
        return None
    n = struct.unpack_from("<I", b, at + 4)[0] + 8
    if n < 12 or at + n > len(b):
        return None
    if b[at + 8 : at + 12] == b"WAVE":
        kinds = [k for k, _, _ in _chunks(b, at, n)]
        return n if kinds[:1] == [b"fmt "] and b"data" in kinds else None
    return n if b[at + 8 : at + 12] in (b"WEBP", b"AVI ") else None


def _chunks(b: bytes, at: int, n: int) -> list[tuple[bytes, int, int]]:
    """Kind, start and length of a RIFF file's chunks; empty if they don't fill it."""
    out, i = [], at + 12
    while i + 8 <= at + n:
        kind, size = struct.unpack_from("<4sI", b, i)
        if i + 8 + size > at + n:
            return []
        out.append((kind, i + 8, size))
        i += 8 + size + size % 2
    return out if i == at + n else []


def _bmp(b: bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    n, zero, offset, head = struct.unpack_from("<IIII", b, at + 2)
    return n if zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= offset <= n <= len(b) - at else None


def _pdf(b: bytes, at: int) -> int | None:
    if re.compile(rb"%PDF-\d\.\d").match(b, at) is None:
        return None
    end, nxt = -1, b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, nxt if nxt > 0 else len(b))
    return end + 5 - at if end > 0 and b.rfind(b"startxref", at, end) > 0 else None


def _zip(b: bytes, at: int) -> int | None:
    i = b.find(b"PK\x05\x06", at)
    while 0 <= i <= len(b) - 22:
        size, offset, note = struct.unpack_from("<IIH", b, i + 12)
        if at + offset + size == i and b[at + offset : at + offset + 4] == b"PK\x01\x02" and i + 22 + note <= len(b):
            return i + 22 + note - at
        i = b.find(b"PK\x05\x06", i + 4)
    return None


def _gzip(b: bytes, at: int) -> int | None:
    z = zlib.decompressobj(31)
    rest = b[at:]
    try:
        while not z.eof:
            if not z.decompress(rest, 1 << 20) and not z.unconsumed_tail and not z.eof:
                return None
            rest = z.unconsumed_tail
    except zlib.error:
        return None
    return len(b) - at - len(z.unused_data)


def _ogg(b: bytes, at: int) -> int | None:
    i = at
    while b[i : i + 4] == b"OggS" and i + 27 <= len(b) and b[i + 4] == 0:
        n = b[i + 26]
        if i + 27 + n > len(b):
            return None
        last = b[i + 5] & 4
        i += 27 + n + sum(b[i + 27 : i + 27 + n])
        if i > len(b):
            return None
        if last:
            return i - at
    return None


def _pgm(b: bytes, at: int) -> int | None:
    m = re.compile(rb"P5\s+(\d{1,6})\s+(\d{1,6})\s+(\d{1,5})\s").match(b, at)
    if m is None or not 0 < int(m[3]) < 65536:
        return None
    n = m.end() - at + int(m[1]) * int(m[2]) * (1 if int(m[3]) < 256 else 2)
    return n if int(m[1]) and int(m[2]) and at + n <= len(b) else None


#: Magic numbers, media type and validator (fixed values of the formats).
SIGNATURES: list[tuple[bytes, str, Callable[[bytes, int], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "riff", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "audio/ogg", _ogg),
    (b"P5", "image/x-portable-graymap", _pgm),
]
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
#: Types that a validator can confirm.
CHECKED = frozenset({kind for _, kind, _ in SIGNATURES} | set(RIFF_TYPES.values())) - {"riff"}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), i)
    a.make_automaton()
    return a


def places(b: bytes) -> list[tuple[int, int]]:
    """Offset and signature number of every magic number."""
    return sorted((end - len(SIGNATURES[i][0]) + 1, i) for end, i in automaton().iter(b.decode("latin-1")))


def sniff(b: bytes, found: list[tuple[int, int]] | None = None, start: int = 0) -> list[tuple[int, int, str]]:
    """Offset, length and type of the confirmed objects from start on, none inside another."""
    out, free = [], start
    for at, i in places(b) if found is None else found:
        if at >= free and (n := SIGNATURES[i][2](b, at)):
            kind = SIGNATURES[i][1]
            out.append((at, n, RIFF_TYPES[b[at + 8 : at + 12]] if kind == "riff" else kind))
            free = at + n
    return out


def pack(data: bytes) -> tuple[bytes, int]:
    """The bytes as a WAV file of 8-bit mono samples, and the number of samples."""
    n = max(UNIT, -(-len(data) // UNIT) * UNIT)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + data + bytes(n - len(data)), n


def unpack(media: bytes) -> bytes:
    """The samples of a validated WAV file."""
    n = _riff(media, 0) if media[:4] == b"RIFF" else None
    for kind, at, size in _chunks(media, 0, n) if n else []:
        if kind == b"data":
            return media[at : at + size]
    raise ValueError("no valid WAV data")


def describe(media: bytes, declared: str, data: bytes) -> str:
    """The corrected type of the stored form, its declared one, figures of the samples, and type and embedded objects of the data."""
    found = places(media)
    whole = sniff(media, [x for x in found if x[0] == 0])
    kind = whole[0][2] if whole and whole[0][1] == len(media) else UNKNOWN
    samples = np.frombuffer(unpack(media), np.uint8)
    counts = np.bincount(samples, minlength=256)
    total = int((counts * np.arange(256)).sum())
    inner = sniff(media, [x for x in found if x[0] >= 44], 44)
    parts = [f"type={kind}", f"declared={declared}", f"fixed={int(kind != declared)}", f"samples={len(samples)}", f"sum={total}", f"values={int((counts > 0).sum())}"]
    parts.append("content=" + (inner[0][2] if inner and inner[0][:2] == (44, len(data)) else plain_type(data)))
    parts.append("carved=" + "|".join(f"{k}@{at - 44}+{n}" for at, n, k in inner))
    return ";".join(parts)


def plain_type(data: bytes) -> str:
    """The type of bytes that are no object of a known format as a whole."""
    try:
        data.decode()
    except UnicodeDecodeError:
        return UNKNOWN
    return UNKNOWN if b"\0" in data else "text/plain" if data else "application/x-empty"


def corrected(data: bytes, declared: str) -> str:
    """The type of bytes as a whole: the confirmed one, else the declared one unless that is a type whose check failed."""
    found = sniff(data, [x for x in places(data) if x[0] == 0])
    if found and found[0][1] == len(data):
        return found[0][2]
    return plain_type(data) if declared in CHECKED or not declared else declared


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_record(data: bytes, declared: str = UNKNOWN) -> tuple:
    media, _ = pack(data)
    back = unpack(media)
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(media, declared, data)


def stored_media(text: Column, declared: Column | None = None) -> Column:
    """declared: the media type that each row claims for its stored form; null or none is UNKNOWN."""
    names = [x.split()[0] for x in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def run(texts: pd.Series, claims: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([media_record(bytes(t), c) for t, c in zip(texts, claims, strict=True)], columns=names)

    claim = F.lit(UNKNOWN) if declared is None else F.coalesce(declared.cast("string"), F.lit(UNKNOWN))
    return run(utf8(text), claim)


def corrected_types(content: Column, declared: Column) -> Column:
    """The media type of each row's bytes, correcting the type that the row declares; null content is empty."""

    @F.pandas_udf("string")
    def run(data: pd.Series, claims: pd.Series) -> pd.Series:
        return pd.Series([corrected(bytes(b), c) for b, c in zip(data, claims, strict=True)], dtype=object)

    return run(utf8(content), F.coalesce(declared.cast("string"), F.lit("")))


def query(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", stored_media(F.col("text")).alias("_m")).select("doc_id", "_m.*")
