"""Media columns: formats made by hand, and texts stored as sound and read back."""

import gzip
import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib

from seqscan.llm import media


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\1\0\1\0\x80\0\0" + b"\0" * 6 + b"\x2c\0\0\0\0\1\0\1\0\0\2\2\x44\1\0\x3b"
JPEG = b"\xff\xd8\xff\xe0\0\4AB\xff\xda\0\2\1\2\xff\0\3\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIIIHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
PDF = b"%PDF-1.4\nstartxref\n0\n%%EOF"
KINDS = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "application/zip": archive(), "application/gzip": gzip.compress(b"x" * 99), "audio/wav": media.to_wav(b"abc" * 9 + b"d")}


def test_each_format_is_known_and_carved():
    for kind, data in KINDS.items():
        assert media.inspect(data) == [(kind, 0, len(data))], kind
        assert media.verdict("image/x-wrong", data) == (kind, True, [])
        if kind != "application/pdf":
            assert media.inspect(b"junk" + data + b"more") == [(kind, 4, len(data))], kind
        broken = data[: len(data) // 2]
        assert media.verdict(kind, broken)[0] == media.UNKNOWN


def test_brute_force_scan_of_places():
    cell = b"PNG BM RIFF" + KINDS["image/png"] + b"BM\0" + KINDS["image/gif"] + KINDS["audio/wav"] + b"%PDF-"
    plain, free = [], 0
    for at in range(len(cell)):
        for magic, kind, validate in media.FORMATS:
            if at >= free and cell.startswith(magic, at) and (n := validate(memoryview(cell)[at:])):
                plain.append((kind if isinstance(kind, str) else kind(memoryview(cell)[at:]), at, n))
                free = at + n
    assert media.inspect(cell) == plain and len(plain) == 3


def test_sniffed_table(spark):
    rows = [(i, "image/gif", bytearray(d)) for i, d in enumerate(KINDS.values())] + [(None, None, None), (50, "text/plain", bytearray(b"text")), (51, "image/png", bytearray(b"aa" + GIF))]
    got = {r.media_id: r for r in media.sniff(spark.createDataFrame(rows, "media_id long, declared string, content binary")).collect()}
    assert [got[i].media_type for i in range(len(KINDS))] == list(KINDS)
    assert (got[50].media_type, got[50].corrected) == ("text/plain", False)
    assert (got[51].media_type, got[51].embedded[0].type, got[51].embedded[0].offset) == (media.UNKNOWN, "image/gif", 2)
    assert got[None].n_bytes == 0


def test_texts_as_sound(spark):
    texts = ["", None, "é" * 288, "a" * 575, "a" * 577, "x %PDF-1 RIFF BM" * 3000]
    docs = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)] + [(None, "n", b""), (1, None, b"")], "doc_id long, text string, content binary")
    rows = media.op6(docs).collect()
    assert len(rows) == 8 and media.op6(docs.limit(0)).collect() == []
    content = {r.media_id: bytes(r.content) for r in media.text_media(docs).collect()}
    for r in rows:
        if r.doc_id is None:
            continue
        text = (texts[r.doc_id] or "").encode()
        payload = text + b"\xff" * (-len(text) % 576 or (0 if text else 576))
        with wave.open(io.BytesIO(content[r.doc_id])) as sound:
            assert sound.readframes(sound.getnframes()) == payload and sound.getsampwidth() == 1
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_sha256 == hashlib.sha256(content[r.doc_id]).hexdigest() and r.media_bytes == len(content[r.doc_id])
        assert r.media_type == "audio/wav" and r.corrected and r.feature.startswith(f"n={len(payload)};")


def test_two_documents_in_a_cell_and_updates_of_one():
    update = PDF + b"\n4 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF"
    assert media.inspect(PDF + b" and " + PDF) == [("application/pdf", 0, len(PDF)), ("application/pdf", len(PDF) + 5, len(PDF))]
    assert media.inspect(update) == [("application/pdf", 0, len(update))]
    assert media.inspect(PDF + b"\nsome words, startxref\n1\n%%EOF") == [("application/pdf", 0, len(PDF))]
    zips = archive() + b"--" + archive()
    assert media.inspect(zips) == [("application/zip", 0, len(archive())), ("application/zip", len(archive()) + 2, len(archive()))]
    named = io.BytesIO()
    with gzip.GzipFile("a.txt", "wb", fileobj=named) as f:
        f.write(b"named " * 500)
    assert media.inspect(b"x" + named.getvalue() + b"y") == [("application/gzip", 1, len(named.getvalue()))]
    assert media.inspect(named.getvalue()[:-1] + b"?") == []  # a wrong size


def test_many_marks_in_linear_time():
    began = time.perf_counter()
    for mark in (b"PK\3\4", b"%PDF-1", b"\x1f\x8b\x08", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"BM", b"RIFF", b"PK\5\6", b"PK\3\4PK\5\6", b"startxref 1 %%EOF"):
        assert media.inspect(mark * (1_000_000 // len(mark))) == []
    assert time.perf_counter() - began < 60


def test_marks_whose_blocks_run_to_the_end_in_linear_time():
    import time

    mark = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x21\xf9"
    shapes = [(mark + bytes([4]) + b"abcd") * 52_000, (mark + bytes([200])) * 60_000, (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd" + b"e" * 8) * 45_000, b"\xff\xd8\xff\xda\x00\x02" * 170_000]
    for data in shapes:
        began = time.perf_counter()
        assert media.inspect(data) == []
        assert time.perf_counter() - began < 15


def test_walks_that_failed_do_not_hide_media():
    picture = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x21\xf9\x04abcd\0" + b"\x3b"
    broken = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x21\xf9\x03abc\0\x55"
    assert [(a, n) for _, a, n in media.inspect(broken + broken + picture + picture)] == [(2 * len(broken), len(picture)), (2 * len(broken) + len(picture), len(picture))]
