"""FASTA and FASTQ records from bytes, formats mixed or not, gzipped or not."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterable, Iterator
from contextlib import nullcontext
from io import BytesIO
from typing import BinaryIO


class FormatError(ValueError):
    """A quality string that does not fit its sequence, or a file that ends within a record."""


def lines_of(source: BinaryIO) -> Iterator[bytes]:
    """Lines without their ends. Gzip is told by its magic number, whatever the file is called, and inflated as it is read."""
    head = source.read(2)
    source.seek(0)
    with gzip.GzipFile(fileobj=source) if head == b"\x1f\x8b" else nullcontext(source) as data:
        for line in data:
            yield line[:-1] if line.endswith(b"\n") else line


def inflated_lines(pieces: Iterable[bytes], step: int = 1 << 20) -> Iterator[bytes]:
    """Lines, without their ends, of gzip content that comes in pieces; members follow each other. Content that ends within
    a member raises FormatError."""
    packed, rest, begun = zlib.decompressobj(31), b"", False
    for piece in pieces:
        while piece:
            if packed.eof:
                piece = piece.lstrip(b"\0")
                packed = zlib.decompressobj(31) if piece else packed
                continue
            begun = True
            *whole, rest = (rest + packed.decompress(piece, step)).split(b"\n")
            yield from whole
            piece = packed.unused_data if packed.eof else packed.unconsumed_tail
    while begun and not packed.eof:
        more = packed.decompress(packed.unconsumed_tail, step)
        if not more:
            raise FormatError("gzip content that ends within a member")
        *whole, rest = (rest + more).split(b"\n")
        yield from whole
    if rest:
        yield rest


def joined(parts: bytearray, more: bytes) -> None:
    parts += more
    if len(parts) > 1 and parts[-1] == 13:
        del parts[-1]


def records_of(lines: Iterable[bytes], permissive: bool = False) -> Iterator[tuple[bytes, bytes, bytes | None]]:
    """(header, sequence, quality or None) of each record; no more than a record is held.

    Bytes before the first `>` or `@` are skipped, also within a line. In a record, a line that begins with either starts
    the next record and one that begins with `+` the quality, which is read until it is as long as the sequence. A
    trailing carriage return goes unless it is all there is. Records without sequence are kept. An ill-fitting quality
    raises FormatError; if `permissive`, what follows is left out without a word.
    """
    rest = iter(lines)
    begun: bytes | None = None
    while True:
        while begun is None:
            line = next(rest, None)
            if line is None:
                return
            start = min((p for p in (line.find(b">"), line.find(b"@")) if p >= 0), default=-1)
            begun = line[start + 1 :] if start >= 0 else None
        header, sequence, quality = bytearray(), bytearray(), None
        joined(header, begun)
        begun = None
        for line in rest:
            if line[:1] in (b">", b"@"):
                begun = line[1:]
                break
            if line[:1] == b"+":
                quality = bytearray()
                for more in rest:
                    joined(quality, more)
                    if len(quality) >= len(sequence):
                        break
                break
            if line:
                joined(sequence, line)
        if quality is not None and len(quality) != len(sequence):
            if permissive:
                return
            raise FormatError(f"record {bytes(header)!r}: quality of {len(quality)} characters for {len(sequence)} residues")
        yield bytes(header), bytes(sequence), None if quality is None else bytes(quality)


def parse(content: bytes, permissive: bool = False) -> Iterator[tuple[bytes, bytes, bytes | None]]:
    """`records_of` the lines of a file's content."""
    return records_of(lines_of(BytesIO(content)), permissive)


def as_text(data: bytes) -> str:
    """UTF-8 if it is, else one character for each byte."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")
