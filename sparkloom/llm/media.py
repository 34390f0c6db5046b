"""Signature sniffing: an Aho-Corasick automaton finds magic bytes, validators confirm structure and length.

A signature alone proves nothing; a span is reported only if its format's validator can walk its structure,
and the walk says how long it is. The sniffed type corrects the declared one, and every confirmed span can be
carved out, wherever it stands.

Work is linear in the bytes, whatever stands in them: the automaton also finds the marks that end a format, looked up by
bisection; where formats are chains of parts, each part is walked once, from whichever signature it is reached; and the
checksum of any part comes from checksums of the bytes before its ends. Only gzip streams are inflated from each start, in
pieces that are not kept.

Defined results: null bytes are empty bytes, of type ``application/octet-stream``; spans are reported outermost
first, ties by the longer and then by type, and a span inside another is reported too; equal bytes give equal results, so
repeated rows each get the same; an empty table gives none; very long texts take several times their size in memory; columns
beside those named are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches

UNKNOWN = "application/octet-stream"
#: Magic bytes, where in the format they stand, and the type they suggest.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"RIFF", 0, "riff"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"BM", 0, "image/bmp"),
)
#: What a RIFF file holds.
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
SAMPLE_RATE = 8000
#: Where the samples of a stored file start, and the type that a text is declared to have.
HEADER, DECLARED = 44, "text/plain"


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


#: Marks near the end of a format.
TRAILERS = (b"%%EOF", b"startxref", b"PK\x05\x06", b"\xff\xd9")


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    """Over bytes read as Latin-1, where each byte is one character."""
    automaton = ahocorasick.Automaton()
    for magic, at, kind in SIGNATURES:
        automaton.add_word(magic.decode("latin-1"), (len(magic) + at, kind))
    for mark in TRAILERS:
        automaton.add_word(mark.decode("latin-1"), (len(mark), mark))
    automaton.make_automaton()
    return automaton


@functools.cache
def _shifts() -> list[list[int]]:
    """Of a CRC-32, what each of its bits becomes when 1, 2, 4, ... zero bytes follow."""
    one = []
    for bit in range(32):
        x = 1 << bit
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        one.append(x)
    out = [one]
    for _ in range(40):
        out.append([_spread(out[-1], _spread(out[-1], 1 << bit)) for bit in range(32)])
    return out


def _spread(rows: list[int], x: int) -> int:
    found, bit = 0, 0
    while x:
        if x & 1:
            found ^= rows[bit]
        x, bit = x >> 1, bit + 1
    return found


class View:
    """Bytes, the places of trailers in them, and what walks have found."""

    STEP = 4096

    def __init__(self, data: bytes) -> None:
        self.b = data
        self.marks: dict[bytes, list[int]] = {mark: [] for mark in TRAILERS}
        self.starts: list[tuple[int, str]] = []
        for last, (length, kind) in _automaton().iter(data.decode("latin-1")):
            if isinstance(kind, bytes):
                self.marks[kind].append(last + 1 - length)
            else:
                self.starts.append((last + 1 - length, kind))
        self.ends: dict[tuple, int | None] = {}
        self.sums: list[int] = []

    def next(self, mark: bytes, at: int) -> int:
        """The first place of a trailer from ``at`` on, or -1."""
        places = self.marks[mark]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def follow(self, step: Callable[[tuple], tuple | int | None], key: tuple) -> int | None:
        """Where a chain of parts ends: ``step`` gives the next part's key, the end, or None for a broken part."""
        path = []
        while key not in self.ends:
            path.append(key)
            after = step(key)
            if not isinstance(after, tuple):
                self.ends[key] = after
                break
            key = after
        self.ends.update(dict.fromkeys(path, self.ends[key]))
        return self.ends[key]

    def crc(self, start: int, end: int) -> int:
        """CRC-32 of a part, from those of all that stands before its two ends."""
        if not self.sums:
            self.sums = [0]
            for at in range(0, len(self.b), self.STEP):
                self.sums.append(zlib.crc32(self.b[at : at + self.STEP], self.sums[-1]))
        low, high = (zlib.crc32(self.b[at - at % self.STEP : at], self.sums[at // self.STEP]) for at in (start, end))
        length, bit = end - start, 0
        while length:
            if length & 1:
                low = _spread(_shifts()[bit], low)
            length, bit = length >> 1, bit + 1
        return low ^ high

    @functools.cached_property
    def archives(self) -> dict[int, int]:
        """End of the archive that starts at a place, from the first end record that says so."""
        out: dict[int, int] = {}
        for end in self.marks[b"PK\x05\x06"]:
            if end + 22 <= len(self.b):
                size, at = struct.unpack_from("<II", self.b, end + 12)
                if self.b[end - size : end - size + 4] == b"PK\x01\x02" and end - size >= 0:
                    out.setdefault(end - at - size, end + 22 + struct.unpack_from("<H", self.b, end + 20)[0])
        return out


def _png(v: View, s: int) -> int | None:
    def step(key: tuple) -> tuple | int | None:
        at = key[1]
        if at + 12 > len(v.b):
            return None
        (size,) = struct.unpack_from(">I", v.b, at)
        end = at + 12 + size
        if end > len(v.b) or v.crc(at + 4, end - 4) != struct.unpack_from(">I", v.b, end - 4)[0]:
            return None
        return end if v.b[at + 4 : at + 8] == b"IEND" else ("png", end)

    return v.follow(step, ("png", s + 8))


def _gif(v: View, s: int) -> int | None:
    b = v.b
    if s + 13 > len(b):
        return None

    def step(key: tuple) -> tuple | int | None:
        kind, at = key
        if at >= len(b):
            return None
        if kind == "gif data":
            return ("gif data", at + b[at] + 1) if b[at] else ("gif", at + 1)
        if b[at] == 0x3B:
            return at + 1
        if b[at] == 0x21:
            return "gif data", at + 2
        if b[at] == 0x2C and at + 10 <= len(b):
            local = b[at + 9]
            return "gif data", at + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        return None

    flags = b[s + 10]
    return v.follow(step, ("gif", s + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)))


def _jpeg(v: View, s: int) -> int | None:
    def step(key: tuple) -> tuple | int | None:
        at = key[1]
        if at + 4 > len(v.b) or v.b[at] != 0xFF:
            return None
        if v.b[at + 1] == 0xDA:
            end = v.next(b"\xff\xd9", at)
            return end + 2 if end >= 0 else None
        return "jpeg", at + 2 + struct.unpack_from(">H", v.b, at + 2)[0]

    return v.follow(step, ("jpeg", s + 2))


def _riff(v: View, s: int) -> int | None:
    b = v.b
    if s + 12 > len(b):
        return None
    end = s + 8 + struct.unpack_from("<I", b, s + 4)[0]
    if end > len(b) or end <= s + 12 or b[s + 8 : s + 12] not in RIFF_KINDS:
        return None

    def step(key: tuple) -> tuple | int | None:
        at = key[2]
        if at + 8 > end:
            return end if at == end else None
        size = struct.unpack_from("<I", b, at + 4)[0]
        return "riff", end, at + 8 + size + size % 2

    return v.follow(step, ("riff", end, s + 12))


def _pdf(v: View, s: int) -> int | None:
    if not v.b[s + 5 : s + 6].isdigit():
        return None
    end = v.next(b"%%EOF", s)
    at = v.next(b"startxref", s)
    return end + 5 if end >= 0 and 0 <= at and at + 9 <= end else None


def _zip(v: View, s: int) -> int | None:
    return v.archives.get(s)


def _gzip(v: View, s: int) -> int | None:
    walk, at = zlib.decompressobj(31), s
    try:
        while not walk.eof and at < len(v.b):
            piece = v.b[at : at + (1 << 16)]
            at += len(piece)
            walk.decompress(piece, 1 << 20)
            while walk.unconsumed_tail and not walk.eof:
                walk.decompress(walk.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return at - len(walk.unused_data) if walk.eof else None


def _bmp(v: View, s: int) -> int | None:
    b = v.b
    if s + 30 > len(b):
        return None
    size, spare, at, header = struct.unpack_from("<IIII", b, s + 2)
    planes = struct.unpack_from("<H", b, s + 26)[0]
    ok = spare == 0 and planes == 1 and header in (40, 108, 124) and 14 + header <= at < size and s + size <= len(b)
    return s + size if ok else None


VALIDATORS = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "riff": _riff, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "image/bmp": _bmp,
}


def sniff(data: bytes | None) -> list[Span]:
    """Every confirmed span, by start and then the longest first."""
    view, found = View(data or b""), set()
    for start, kind in view.starts:
        end = VALIDATORS[kind](view, start)
        if end is not None:
            found.add(Span(RIFF_KINDS[view.b[start + 8 : start + 12]] if kind == "riff" else kind, start, end))
    return sorted(found, key=lambda x: (x.start, -x.end, x.kind))


def correct_type(declared: str | None, data: bytes | None) -> tuple[str, bool]:
    """The type of a file that starts at its first byte, and whether that differs from the declared one."""
    kind = next((x.kind for x in sniff(data) if x.start == 0), UNKNOWN)
    kind = kind if kind != UNKNOWN or not declared or declared in {x[2] for x in SIGNATURES} | set(RIFF_KINDS.values()) else declared
    return kind, kind != declared


def carve(data: bytes | None, spans: list[Span] | None = None) -> Iterator[tuple[str, int, bytes]]:
    """(type, start, bytes) of each outermost span; of the given ones, if they are known."""
    reach = 0
    for span in sniff(data) if spans is None else spans:
        if span.start >= reach:
            yield span.kind, span.start, (data or b"")[span.start : span.end]
            reach = span.end


def store_wav(payload: bytes) -> bytes:
    """Bytes as 8-bit mono samples of a WAV file. The payload's length must be even."""
    form = struct.pack("<HHIIHH", 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(payload)) + payload


def load_wav(data: bytes) -> bytes:
    """The samples of a WAV file, whatever chunks stand before them."""
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(text: str | None) -> tuple:
    """A text's payload stored as a WAV file, carved out by its signature, and read back.

    The feature names what was carved, the text's declared and sniffed type, and every span inside.
    """
    n, payload = padded(text)
    stored = store_wav(payload)
    spans = sniff(stored)
    kind, at, media = next(carve(stored, spans))
    back = load_wav(media)
    inner = [x for x in spans if x.start > 0]
    sniffed_type = next((x.kind for x in inner if x.start == HEADER), DECLARED)
    feature = f"{kind}@{at}+{len(media)};{DECLARED}>{sniffed_type}" + "".join(f";{x.kind}@{x.start}+{x.end - x.start}" for x in inner)
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def media_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, then the columns of ``MEDIA``), one row per input row."""
    small_batches(df.sparkSession)

    @F.pandas_udf(MEDIA)
    def digests(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([digest(t) for t in texts], columns=[x.split()[0] for x in MEDIA.split(", ")])

    return df.select(F.col(f"`{doc_id}`").alias(doc_id), digests(F.col(f"`{text}`").cast("string")).alias("m")).select(doc_id, "m.*")


def sniffed(df: DataFrame, data: str, declared: str | None = None) -> DataFrame:
    """``df`` with ``media``: corrected type, whether it was wrong, and all spans of a column of bytes."""

    @F.pandas_udf("kind string, corrected boolean, spans array<struct<kind:string,start:long,end:long>>")
    def look(bodies: pd.Series, types: pd.Series) -> pd.DataFrame:
        rows = [(*correct_type(t, b), [(x.kind, x.start, x.end) for x in sniff(b)]) for b, t in zip(bodies, types, strict=True)]
        return pd.DataFrame(rows, columns=["kind", "corrected", "spans"])

    return df.withColumn("media", look(F.col(f"`{data}`"), F.col(f"`{declared}`") if declared else F.lit(None).cast("string")))
