"""Media columns: signature sniffing, and texts stored as sound.

An Aho-Corasick automaton finds every magic number of a binary cell in one pass; at each place a validator of the format
confirms structure and length. What is confirmed at the cell's start and fills it corrects the declared type; what lies
within it is carved as embedded media, outermost first.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A payload is padded with PAD to a positive multiple of UNIT bytes.
UNIT, PAD, RATE = 576, b"\xff", 8000
UNKNOWN = "application/octet-stream"


def png(b: memoryview) -> int | None:
    at = 8
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        if (at == 8) != (kind == b"IHDR") or (at == 8 and n != 13) or at + 12 + n > len(b) or zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return None
        at += 12 + n
        if kind == b"IEND":
            return at
    return None


def gif(b: memoryview, failed: set[int] | None = None, start: int = 0) -> int | None:
    """`failed` are the states (twice the place in the cell, odd within blocks) from which an earlier walk came to nothing:
    a walk that gets into one ends there, and leaves those it went through if it fails itself."""
    if len(b) < 14:
        return None
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 128 else 0)
    failed = set() if failed is None else failed
    gone: list[int] = []

    def new(state: int) -> bool:
        gone.append(state)
        return state not in failed

    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            if not new(2 * (start + at) + 1):
                return len(b)
            at += 1 + b[at]
        return at + 1

    while at < len(b) and new(2 * (start + at)):
        if b[at] == 0x3B:
            return at + 1
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            at = blocks(at + 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0))
        else:
            break
    failed.update(gone)
    return None


def jpeg(b: memoryview, failed: set[int] | None = None, start: int = 0) -> int | None:
    """`failed` as in `gif`: twice the place of a mark in the cell, odd within a scan."""
    at, scan = 2, False
    failed = set() if failed is None else failed
    gone: list[int] = []
    while at + 2 <= len(b):
        if b[at] != 0xFF:
            if not scan:
                break
            at += 1
            continue
        state = 2 * (start + at) + scan
        if state in failed:
            break
        gone.append(state)
        mark = b[at + 1]
        if mark == 0xD9:
            if scan:
                return at + 2
            break
        if mark == 0xFF:
            at += 1
        elif mark == 0 or 0xD0 <= mark <= 0xD7:
            if not scan:
                break
            at += 2
        elif at + 4 <= len(b) and mark >= 0xC0 and (n := struct.unpack_from(">H", b, at + 2)[0]) >= 2:
            scan |= mark == 0xDA
            at += 2 + n
        else:
            break
    failed.update(gone)
    return None


def riff(b: memoryview) -> int | None:
    """A RIFF file whose chunks fill it; sound needs a format and samples."""
    if len(b) < 12:
        return None
    end, at, seen = 8 + struct.unpack_from("<I", b, 4)[0], 12, []
    if end > len(b) or end < 12:
        return None
    while at + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, at)
        seen.append(kind)
        at += 8 + n + n % 2
    fits = at == end or at == end + 1
    return end if fits and seen and (bytes(b[8:12]) != b"WAVE" or {b"fmt ", b"data"} <= set(seen)) else None


def riff_type(b: memoryview) -> str:
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(bytes(b[8:12]), UNKNOWN)


def bmp(b: memoryview) -> int | None:
    if len(b) < 54:
        return None
    size, spare, at, head = struct.unpack_from("<IIII", b, 2)
    return size if spare == 0 and 54 <= at <= size <= len(b) and head in (40, 52, 56, 108, 124) and struct.unpack_from("<H", b, 26)[0] == 1 else None


class Cell:
    """A cell's bytes and where in them the ends of containers stand, each found once however many marks ask for it."""

    def __init__(self, data: bytes | memoryview):
        self.data = bytes(data)
        self.zero = (0, self.data.find(b"\0"))

    @cached_property
    def pdf_starts(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"%PDF-", self.data)]

    @cached_property
    def pdf_ends(self) -> list[tuple[int, int]]:
        """Where a closing part begins and ends: startxref, a number, %%EOF."""
        return [m.span() for m in re.finditer(rb"startxref\s+\d+\s+%%EOF", self.data)]

    @cached_property
    def archives(self) -> dict[int, int]:
        """Of each place where an archive's end says that it begins, the first such end."""
        found: dict[int, int] = {}
        for m in re.finditer(re.escape(b"PK\5\6"), self.data):
            at = m.start()
            if at + 22 <= len(self.data):
                size, start, note = struct.unpack_from("<IIH", self.data, at + 12)
                if self.data[at - size : at - size + 4] == b"PK\1\2" and at - size - start >= 0 and at + 22 + note <= len(self.data):
                    found.setdefault(at - size - start, at + 22 + note)
        return found

    def next_zero(self, at: int) -> int:
        """The next zero byte from `at` on, -1 if none; marks ask in ascending order, so the bytes are searched once."""
        asked, found = self.zero
        if at < asked or 0 <= found < at:
            self.zero = asked, found = at, self.data.find(b"\0", at)
        return found


def pdf_at(cell: Cell, start: int) -> int | None:
    """A PDF to the end of its closing part, or of the last one that updates it: more objects follow at once, and no other PDF begins."""
    if not cell.data[start + 5 : start + 6].isdigit():
        return None
    after = bisect_right(cell.pdf_starts, start)
    limit = cell.pdf_starts[after] if after < len(cell.pdf_starts) else len(cell.data)
    end = None
    for begin, stop in islice(cell.pdf_ends, bisect_right(cell.pdf_ends, (start, 0)), None):
        if stop > limit or (end is not None and not re.compile(rb"\s*(?:\d+ \d+ obj|xref)\b").match(cell.data, end)):
            break
        end = stop
    return None if end is None else end - start


def archive_at(cell: Cell, start: int) -> int | None:
    """A zip whose central directory lies where its end says and begins with an entry's mark."""
    return cell.archives[start] - start if start in cell.archives else None


def gzip_at(cell: Cell, start: int) -> int | None:
    """A gzip member whose header is well formed and whose deflated bytes end with the right check sum and size."""
    data, at = cell.data, start + 10
    flags = data[start + 3] if start + 3 < len(data) else 255
    if flags & 0xE0:
        return None
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for text in (8, 16):
        if flags & text:
            end = cell.next_zero(at)
            if end < 0:
                return None
            at = end + 1
    at += 2 * (flags >> 1 & 1)
    inflate, crc, size, step = zlib.decompressobj(-15), 0, 0, 64
    try:
        while at < len(data) and not inflate.eof:
            rest = data[at : at + step]
            at, step = at + len(rest), min(2 * step, 1 << 16)  # what is no gzip fails within a few bytes
            while rest and not inflate.eof:
                out = inflate.decompress(rest, 1 << 20)
                crc, size, rest = zlib.crc32(out, crc), size + len(out), inflate.unconsumed_tail
    except zlib.error:
        return None
    at -= len(inflate.unused_data)
    fits = inflate.eof and at + 8 <= len(data) and struct.unpack_from("<II", data, at) == (crc, size & 0xFFFFFFFF)
    return at + 8 - start if fits else None


def pdf(b: memoryview) -> int | None:
    return pdf_at(Cell(b), 0)


def archive(b: memoryview) -> int | None:
    return archive_at(Cell(b), 0)


def gzipped(b: memoryview) -> int | None:
    return gzip_at(Cell(b), 0)


#: Magic numbers, the type that each announces, and the format's validator.
FORMATS: tuple[tuple[bytes, str | Callable[[memoryview], str], Callable[[memoryview], int | None]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif),
    (b"\xff\xd8\xff", "image/jpeg", jpeg),
    (b"RIFF", riff_type, riff),
    (b"BM", "image/bmp", bmp),
    (b"%PDF-", "application/pdf", pdf),
    (b"PK\3\4", "application/zip", archive),
    (b"\x1f\x8b\x08", "application/gzip", gzipped),
)
#: The validators that look for a container's end, as they go on within a cell.
IN_CELL = {pdf: pdf_at, archive: archive_at, gzipped: gzip_at}
_AUTOMATON: list = []


def automaton():
    """Built once in each worker."""
    if not _AUTOMATON:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, (magic, _, _) in enumerate(FORMATS):
            found.add_word(magic.decode("latin-1"), (i, len(magic)))
        found.make_automaton()
        _AUTOMATON.append(found)
    return _AUTOMATON[0]


def inspect(content: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the confirmed media in order of place; what lies in a confirmed container is not told twice."""
    view, cell, found, free = memoryview(content), Cell(content), [], 0
    failed: dict[Callable, set[int]] = {gif: set(), jpeg: set()}
    for last, (i, n) in automaton().iter(content.decode("latin-1")):
        start = last - n + 1
        if start >= free or not found:
            _, kind, validate = FORMATS[i]
            if validate in IN_CELL:
                length = IN_CELL[validate](cell, start)
            else:
                length = validate(view[start:], failed[validate], start) if validate in failed else validate(view[start:])
            if length:
                found.append((kind if isinstance(kind, str) else kind(view[start:]), start, length))
                free = start + length
    return found


def verdict(declared: str | None, content: bytes | None) -> tuple[str, bool, list[tuple[str, int, int]]]:
    """The true type, whether it corrects the declared one, and what is embedded."""
    found = inspect(content or b"")
    whole = found and found[0][1] == 0 and found[0][2] == len(content)
    actual = found[0][0] if whole else UNKNOWN if declared in {k for _, k, _ in FORMATS if isinstance(k, str)} | {"audio/wav", "image/webp"} else declared or UNKNOWN
    return actual, actual != declared, found[1:] if whole else found


SNIFFED = "media_id long, declared string, media_type string, corrected boolean, n_bytes long, embedded array<struct<type: string, offset: long, length: long>>"


def sniff(media: DataFrame) -> DataFrame:
    """`media` (media_id, declared, content binary) -> rows of SNIFFED, row for row.

    A declared type of a known format that the bytes don't bear out becomes unknown; one of no known format stays. Null
    content is empty: nothing is found in it. Repeated rows are told alike, other columns left out; a cell of any length is
    gone through once, and no walk goes twice where one has failed. An empty table gives an empty result. To carve, take `substring(content, offset + 1, length)`.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content", 8 << 20):
            declared, content = batch.column("declared").to_pylist(), batch.column("content").to_pylist()
            seen = [verdict(d, c) for d, c in zip(declared, content, strict=True)]
            inner = [[{"type": t, "offset": a, "length": n} for t, a, n in v[2]] for v in seen]
            kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            columns = [batch.column("media_id"), batch.column("declared"), pa.array([v[0] for v in seen]), pa.array([v[1] for v in seen]), pa.array([len(c or b"") for c in content], pa.int64()), pa.array(inner, kind)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ("media_id", "declared", "media_type", "corrected", "n_bytes", "embedded")])

    return media.select(F.col("media_id").cast("long"), F.col("declared").cast("string"), F.col("content").cast("binary")).mapInArrow(run, SNIFFED)


def to_wav(payload: bytes) -> bytes:
    """Bytes as unsigned 8-bit samples of one channel."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(content: bytes) -> bytes:
    """The samples of the first data chunk."""
    at = 12
    while at + 8 <= len(content):
        kind, n = struct.unpack_from("<4sI", content, at)
        if kind == b"data":
            return content[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    return b""


def feature(samples: bytes) -> str:
    """Whole-number features of the samples around their middle: count, mean, energy, crossings, and most frequent level."""
    wave = np.frombuffer(samples, np.uint8)
    if not len(wave):
        return "n=0"
    centred = wave.astype(np.int16) - 128
    up = centred >= 0
    levels = np.bincount(wave, minlength=256)
    return f"n={len(wave)};sum={int(centred.sum(dtype=np.int64))};energy={int(np.square(centred, dtype=np.int64).sum())};crossings={int(np.count_nonzero(up[1:] != up[:-1]))};mode={int(levels.argmax())};levels={int(np.count_nonzero(levels))}"


def padded(text: bytes) -> bytes:
    return text + PAD * (-len(text) % UNIT if text else UNIT)


def text_media(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) -> (media_id, declared, content): each text as a sound, null as empty; other columns are left out."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            content = [to_wav(padded(t or b"")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(["image/png"] * len(content)), pa.array(content, pa.binary())], ["media_id", "declared", "content"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "media_id long, declared string, content binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, n_embedded long"


def op6(docs: DataFrame) -> DataFrame:
    """Texts stored as sound under a wrong declared type, sniffed, read back from where the sound was found, measured.

    Null text is an empty one, stored as padding alone. Row for row; repeated rows give the same values, an empty table an
    empty result; other columns are not looked at. A
    text takes a few times its own length in memory, and time in proportion to it.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            rows = []
            for text in batch.column("text").to_pylist():
                content = to_wav(padded(text or b""))
                kind, corrected, inner = verdict("image/png", content)
                payload = from_wav(content) if kind == "audio/wav" else b""
                rows.append((len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(content), hashlib.sha256(content).hexdigest(), feature(payload), kind, corrected, len(inner)))
            names = [x.split()[0] for x in READ.split(", ")]
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, READ)
