"""Signature sniffing over binary columns.

An Aho-Corasick automaton finds all magic bytes in one pass over the bytes; a validator for each format
then reads headers, sizes and checksums, so that a magic that merely occurs in other data is discarded.
What is left gives the true type (the segment at byte 0) and the segments to carve, embedded ones too.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.words import session_limits

SEGMENTS = "array<struct<kind:string,start:bigint,stop:bigint>>"
UNKNOWN = "application/octet-stream"
#: The end of a PDF revision, and what its number points to.
REVISION = re.compile(rb"startxref\s+(\d{1,12})\s+%%EOF")
TABLE = re.compile(rb"\s*(?:xref\b|\d+\s+\d+\s+obj\b)")


def _u32(b: bytes, at: int, order: str = "<") -> int:
    return struct.unpack_from(order + "I", b, at)[0] if at + 4 <= len(b) else -1


def riff_end(b: bytes, at: int) -> int:
    """RIFF files with WAVE, AVI or WEBP content whose chunks fill the stated size."""
    size = _u32(b, at + 4)
    end = at + 8 + size
    if size < 4 or end > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"AVI ", b"WEBP"):
        return -1
    place = at + 12
    while place + 8 <= end:
        step = _u32(b, place + 4)
        place += 8 + step + step % 2
    return end if place in (end, end + 1) else -1


def png_end(b: bytes, at: int) -> int:
    place = at + 8
    if b[place + 4 : place + 8] != b"IHDR":
        return -1
    while place + 12 <= len(b):
        size = _u32(b, place, ">")
        if place + 12 + size > len(b) or zlib.crc32(b[place + 4 : place + 8 + size]) != _u32(b, place + 8 + size, ">"):
            return -1
        kind = b[place + 4 : place + 8]
        place += 12 + size
        if kind == b"IEND":
            return place
    return -1


def gif_end(b: bytes, at: int) -> int:
    if len(b) < at + 13 or b[at + 4 : at + 6] not in (b"7a", b"9a"):
        return -1
    place = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while place < len(b):
        mark = b[place]
        if mark == 0x3B:
            return place + 1
        if mark == 0x21:
            place += 2
        elif mark == 0x2C and place + 10 < len(b):
            place += 10 + (3 << ((b[place + 9] & 7) + 1) if b[place + 9] & 0x80 else 0) + 1
        else:
            return -1
        while place < len(b) and b[place]:
            place += b[place] + 1
        place += 1
    return -1


def jpeg_end(b: bytes, at: int) -> int:
    place = at + 2
    while place + 4 <= len(b) and b[place] == 0xFF:
        mark = b[place + 1]
        size = struct.unpack_from(">H", b, place + 2)[0]
        if size < 2:
            return -1
        place += 2 + size
        if mark == 0xDA:
            end = b.find(b"\xff\xd9", place)
            return end + 2 if end >= 0 else -1
    return -1


def bmp_end(b: bytes, at: int) -> int:
    size, start, header = _u32(b, at + 2), _u32(b, at + 10), _u32(b, at + 14)
    good = b[at + 6 : at + 10] == bytes(4) and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start < size
    return at + size if good and at + size <= len(b) else -1


def pdf_end(b: bytes, at: int) -> int:
    """Up to the last revision whose startxref leads to a table or an object of this file; without one, the first end mark.

    A revision's table comes after the revision before it, so a second file that follows is not one.
    """
    end = b.find(b"%%EOF", at)
    if end < 0 or not b[at + 5 : at + 6].isdigit():
        return -1
    stop, after = end + 5, at
    for mark in REVISION.finditer(b, at):
        place = at + int(mark[1])
        if after <= place < mark.start() and place > at and TABLE.match(b, place):
            stop = after = mark.end()
    return stop


def gzip_end(b: bytes, at: int) -> int:
    work = zlib.decompressobj(31)
    try:
        place = at
        while place < len(b) and not work.eof:
            work.decompress(work.unconsumed_tail or b[place : place + 65536], 1 << 20)
            place += 0 if work.unconsumed_tail else 65536
    except zlib.error:
        return -1
    return min(place, len(b)) - len(work.unused_data) if work.eof else -1


def zip_end(b: bytes, at: int) -> int:
    """The first end record whose sizes agree; those of stored archives do not."""
    end = b.find(b"PK\x05\x06", at)
    while 0 <= end <= len(b) - 22:
        stop = end + 22 + struct.unpack_from("<H", b, end + 20)[0]
        if stop <= len(b) and _u32(b, end + 12) + _u32(b, end + 16) == end - at:
            return stop
        end = b.find(b"PK\x05\x06", end + 1)
    return -1


def ogg_end(b: bytes, at: int) -> int:
    """A first page and the pages that follow it directly; later pages are no starts."""
    if len(b) < at + 27 or not b[at + 5] & 2:
        return -1
    place = at
    while b[place : place + 4] == b"OggS" and place + 27 <= len(b):
        lace = b[place + 27 : place + 27 + b[place + 26]]
        last = b[place + 5] & 4
        place += 27 + len(lace) + sum(lace)
        if place > len(b):
            return -1
        if last:
            return place
    return -1


def flac_end(b: bytes, at: int) -> int:
    """The metadata blocks are checked; the frames reach to the end of the bytes."""
    return len(b) if b[at + 4 : at + 8] in (b"\x00\x00\x00\x22", b"\x80\x00\x00\x22") and len(b) >= at + 42 else -1


def mp4_end(b: bytes, at: int) -> int:
    place, seen = at, 0
    while place + 8 <= len(b):
        size = _u32(b, place, ">")
        if size < 8 or place + size > len(b) or not b[place + 4 : place + 8].isalnum():
            break
        place, seen = place + size, seen + 1
    return place if seen > 1 else -1


# Magic bytes, their place in the file, the type and its validator.
SIGNATURES = (
    (b"RIFF", 0, "riff", riff_end),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", png_end),
    (b"GIF8", 0, "image/gif", gif_end),
    (b"\xff\xd8\xff", 0, "image/jpeg", jpeg_end),
    (b"BM", 0, "image/bmp", bmp_end),
    (b"%PDF-", 0, "application/pdf", pdf_end),
    (b"\x1f\x8b\x08", 0, "application/gzip", gzip_end),
    (b"PK\x03\x04", 0, "application/zip", zip_end),
    (b"OggS", 0, "audio/ogg", ogg_end),
    (b"fLaC", 0, "audio/flac", flac_end),
    (b"ftyp", 4, "video/mp4", mp4_end),
)
RIFF_KINDS = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}


@functools.lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for j, (magic, *_) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), j)
    found.make_automaton()
    return found


def segments(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of every validated file in the bytes, by place; embedded ones follow their host."""
    out = []
    for last, j in _automaton().iter(data.decode("latin-1")):
        magic, offset, kind, validator = SIGNATURES[j]
        start = last + 1 - len(magic) - offset
        stop = validator(data, start) if start >= 0 else -1
        if stop > start:
            out.append((RIFF_KINDS[data[start + 8 : start + 12]] if kind == "riff" else kind, start, stop))
    return sorted(out, key=lambda s: (s[1], -s[2]))


def sniff(table: DataFrame, media_col: str, declared_col: str | None = None, into: str = "sniffed") -> DataFrame:
    """Add ``into``: the true kind, whether the declared one was right, and all segments.

    Bytes that no validator accepts at byte 0 keep the general kind; null bytes have a null kind and no
    segments. Rows and other columns stay; a column named as ``into`` is replaced.
    """
    session_limits(table.sparkSession)

    @F.pandas_udf(SEGMENTS)
    def find(media: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "stop": b} for k, a, b in segments(bytes(m))] if m is not None else [] for m in media])

    found = F.col("__found")
    at_zero = F.get(F.filter(found, lambda s: s["start"] == 0), F.lit(0))["kind"]
    kind = F.when(F.col(media_col).isNotNull(), F.coalesce(at_zero, F.lit(UNKNOWN)))
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    return table.withColumn("__found", find(F.col(media_col))).withColumn(
        into, F.struct(kind.alias("kind"), declared.eqNullSafe(kind).alias("declared_right"), found.alias("segments"))
    ).drop("__found")


def carve(table: DataFrame, media_col: str, sniffed_col: str = "sniffed") -> DataFrame:
    """One row for each segment: the other columns, kind, start and the carved bytes."""
    rows = table.withColumn("__segment", F.explode(F.col(sniffed_col)["segments"]))
    piece = F.expr(f"substring(`{media_col}`, CAST(__segment.start + 1 AS INT), CAST(__segment.stop - __segment.start AS INT))")
    return rows.select("*", F.col("__segment.kind").alias("kind"), F.col("__segment.start").alias("start"), piece.alias("carved")).drop("__segment")


BLOCK = 64
RATE = 8000


def wav(payload: bytes) -> bytes:
    """Mono audio of 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(data: bytes) -> tuple[bytes, str]:
    """Samples of a wave file and a feature of them: format, length, mean, mean change and loudest place."""
    import numpy as np

    place, form, found = 12, None, b""
    while place + 8 <= len(data):
        size = _u32(data, place + 4)
        if data[place : place + 4] == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, place + 8)
        elif data[place : place + 4] == b"data":
            found = data[place + 8 : place + 8 + size]
        place += 8 + size + size % 2
    x = np.frombuffer(found, np.uint8).astype(np.int64)
    change = np.abs(np.diff(x)).sum()
    return found, f"wav:{form[1]}x{form[5]}@{form[2]};n={len(x)};sum={x.sum()};change={change};peak={int(x.argmax()) if len(x) else -1}"


def store_texts(docs: DataFrame, text_col: str = "text", into: str = "media") -> DataFrame:
    """Add the text as wave audio: its UTF-8 bytes, filled up with zero bytes, are the samples.

    A null text counts as empty; a column named as ``into`` is replaced, the others stay.
    """
    session_limits(docs.sparkSession)

    @F.pandas_udf("binary")
    def build(texts: pd.Series) -> pd.Series:
        raw = [b"" if t is None else t.encode() for t in texts]
        return pd.Series([wav(b + bytes(max(BLOCK, -(-len(b) // BLOCK) * BLOCK) - len(b))) for b in raw])

    return docs.withColumn(into, build(F.col(text_col)))


def read_samples(table: DataFrame, media_col: str = "media", into: str = "read") -> DataFrame:
    """Add the samples read back from wave bytes, and their feature; null where the bytes are null.

    A column named as ``into`` is replaced, the others stay.
    """
    session_limits(table.sparkSession)

    @F.pandas_udf("struct<payload:binary,feature:string>")
    def read(media: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([samples(bytes(m)) if m is not None else (None, None) for m in media], columns=["payload", "feature"])

    return table.withColumn(into, read(F.col(media_col)))
