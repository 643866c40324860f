"""Duplicate passages: documents are parsed against indexed reference blocks, long factors are duplicate spans.

Every document's windows of WINDOW words are the reference, hashed into blocks: a block indexes, for each window that
falls to it, the smallest document that holds it and the first place there. Each document meets every block with its own
windows and gets back those that an earlier document owns; from them its greedy relative Lempel-Ziv parse is made: a
factor is taken at the leftmost matched word not yet parsed and follows its reference, word by word, as far as the two
agree. A factor is thus a piece of the reference at a stated place. A window that lies across a factor's end is checked
there by its own match, so that a passage which goes on elsewhere is covered to its last word. All factors are WINDOW
words or longer; the words they cover are the duplicates.

Windows travel packed: one row per batch of documents and block, with the windows' hashes, 7 bytes each, and their
places as gaps. The block is named by other bits than those; so 56 + log2(blocks) bits tell windows apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

WINDOW = 13
#: Bytes of text whose windows are packed together.
BATCH = 12 << 20
BLOCKS = "block int, docs binary, rows binary, counts binary, gaps binary, low binary, mid binary, high binary"
OWNED = "answer int, docs binary, rows binary, counts binary, pos binary, owner binary, place binary"
#: Rows with duplicates whose ids all tasks are told at most (16 bytes each); beyond that all texts are shuffled.
BROADCAST_IDS = 1_000_000


def coefficients(window: int) -> np.ndarray:
    """Odd 64-bit multipliers, one for each word of a window, from the splitmix64 sequence."""
    with np.errstate(over="ignore"):
        z = np.arange(1, window + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) | np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array(list(map(xxh3_64_intdigest, words)), dtype=np.uint64)


def window_hashes(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash of each `window` consecutive words, from the words' hashes: multilinear, then mixed."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(coefficients(window)):
            total += words[j : j + n] * c
        total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return total ^ (total >> np.uint64(29))


def parse(owned: np.ndarray, owner: np.ndarray, place: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, reference, place there) from the sorted starts of matched windows, who owns them and where.

    A factor goes on while the next word's window is matched at the next place of the same document; where it is matched
    elsewhere, that window is checked at the boundary and opens the next factor.
    """
    if not len(owned):
        return []
    breaks = np.flatnonzero((np.diff(owned) != 1) | (np.diff(owner) != 0) | (np.diff(place) != 1)) + 1
    first = np.concatenate(([0], breaks))
    last = np.concatenate((breaks, [len(owned)])) - 1
    return list(zip(owned[first].tolist(), (owned[last] + window).tolist(), owner[first].tolist(), place[first].tolist(), strict=True))


def covered(n_words: int, factors: list[tuple]) -> np.ndarray:
    steps = np.zeros(n_words + 1, np.int64)
    for a, b, *_ in factors:
        steps[a] += 1
        steps[b] -= 1
    return np.cumsum(steps)[:n_words] > 0


def packed_windows(docs: DataFrame, blocks: int, window: int = WINDOW) -> DataFrame:
    """`docs` (doc_id, row, text binary) -> rows of BLOCKS. Documents without doc_id or with fewer words than a window: none."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            ids, rows, counts, hashes = [], [], [], []
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                words = text.split() if text and doc is not None else ()
                if len(words) >= window:
                    ids.append(doc)
                    rows.append(row)
                    hashes.append(window_hashes(word_hashes(words), window))
                    counts.append(len(hashes[-1]))
            if not ids:
                continue
            hashes = np.concatenate(hashes)
            doc_of = np.repeat(np.arange(len(ids)), counts)
            pos = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
            with np.errstate(over="ignore"):
                block = ((hashes * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(40)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            all_ids, all_rows = np.array(ids, dtype="<i8"), np.array(rows, dtype="<i8")
            out: list[tuple] = []
            for b, own in runs(block[order], order):
                present, n = np.unique(doc_of[own], return_counts=True)
                at = np.cumsum(n) - n
                gaps = np.diff(pos[own], prepend=0)
                gaps[at] = pos[own][at]
                h = hashes[own]
                out.append((b, all_ids[present].tobytes(), packed_rows(all_rows[present]), n.astype("<u4").tobytes(), pack_gaps(gaps.astype("<u4")), h.astype("<u4").tobytes(), (h >> np.uint64(32)).astype("<u2").tobytes(), (h >> np.uint64(48)).astype("u1").tobytes()))
            fields = list(zip(*out, strict=True))
            data = [pa.array(c, pa.binary()) for c in fields[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(fields[0], pa.int32()), *data], [f.split()[0] for f in BLOCKS.split(", ")])

    return docs.mapInArrow(run, BLOCKS)


def runs(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each key that is there; `keys` are sorted."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    yield from zip(keys[first].tolist(), np.split(values, first[1:]), strict=bool(len(first)))


def packed_rows(rows: np.ndarray) -> bytes:
    """Which of the rows that share a doc_id; nothing where all ids are met once only."""
    return rows.astype("<i8").tobytes() if rows.any() else b""


def unpacked_rows(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i8") if data else np.zeros(n, np.int64)


def pack_gaps(gaps: np.ndarray) -> bytes:
    """Numbers as one byte each; 255 stands for the next one of the four-byte list behind."""
    wide = gaps >= 255
    return np.where(wide, 255, gaps).astype("u1").tobytes() + gaps[wide].astype("<u4").tobytes()


def unpack_gaps(data: bytes, n: int) -> np.ndarray:
    gaps = np.frombuffer(data, "u1", n).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, "<u4", offset=n)
    return gaps


def bucket_of(docs: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def owned_windows(packed: DataFrame, answers: int) -> DataFrame:
    """Rows of BLOCKS -> rows of OWNED: the windows of a document that a document of smaller id holds too, and whose.

    A block's answers are packed by bucket of documents, in order of document and place.
    """
    import pyarrow as pa

    def answer(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        n = [len(r["high"]) for r in rows]
        hashes = np.concatenate([np.frombuffer(r["low"], "<u4").astype(np.uint64) | (np.frombuffer(r["mid"], "<u2").astype(np.uint64) << np.uint64(32)) | (np.frombuffer(r["high"], "u1").astype(np.uint64) << np.uint64(48)) for r in rows])
        doc, row, pos = [], [], []
        for r, k in zip(rows, n, strict=True):
            counts = np.frombuffer(r["counts"], "<u4").astype(np.int64)
            row.append(np.repeat(unpacked_rows(r["rows"], len(counts)), counts))
            doc.append(np.repeat(np.frombuffer(r["docs"], "<i8"), counts))
            places = np.cumsum(unpack_gaps(r["gaps"], k))
            at = np.cumsum(counts) - counts  # sums begin anew with each document
            base = np.where(at > 0, places[at - 1], 0)
            pos.append(places - np.repeat(base, counts))
        doc, row, pos = np.concatenate(doc), np.concatenate(row), np.concatenate(pos)
        order = np.argsort(hashes, kind="stable")
        sorted_hashes = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1])))
        size = np.diff(np.append(first, len(doc)))
        owner, place = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
        least = np.repeat(np.minimum.reduceat(doc[order], first), size)
        owner[order] = least
        # The place in the owner; where several rows share its id, in that of the least row.
        its_row = np.where(doc[order] == least, row[order], np.iinfo(np.int64).max)
        mine = (doc[order] == least) & (its_row == np.repeat(np.minimum.reduceat(its_row, first), size))
        place[order] = np.repeat(np.minimum.reduceat(np.where(mine, pos[order], np.iinfo(np.int64).max), first), size)
        del hashes, sorted_hashes, order, its_row, mine, least
        found = np.flatnonzero(owner < doc)
        found = found[np.lexsort((pos[found], row[found], doc[found]))]
        doc, row, pos, owner, place = doc[found], row[found], pos[found].astype("<u4"), owner[found].astype("<i8"), place[found].astype("<u4")
        to = bucket_of(doc, answers)
        order = np.argsort(to, kind="stable")
        out = []
        for b, own in runs(to[order], order):
            begins = np.flatnonzero(np.concatenate(([True], (np.diff(doc[own]) != 0) | (np.diff(row[own]) != 0))))
            counts = np.diff(np.append(begins, len(own))).astype("<u4")
            out.append((b, doc[own][begins].astype("<i8").tobytes(), packed_rows(row[own][begins]), counts.tobytes(), pos[own].tobytes(), owner[own].tobytes(), place[own].tobytes()))
        if out:
            fields = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(fields[0], pa.int32()), *[pa.array(c, pa.binary()) for c in fields[1:]]], [f.split()[0] for f in OWNED.split(", ")])

    return packed.mapInArrow(grouped("block", answer), OWNED)


def grouped(key: str, handle: Callable) -> Callable:
    """Calls `handle` with the rows of one value of `key` after another; the partition is sorted by it."""

    def run(batches: Iterator) -> Iterator:
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                if held and held[-1][key] != row[key]:
                    yield from handle(held)
                    held = []
                held.append(row)
        if held:
            yield from handle(held)

    return run


def block_count(source: DataFrame) -> int:
    """Blocks so that one holds about 8 MB of text, that is one or two million windows."""
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(12, size // (8 << 20)))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """`docs` -> (doc_id, row, text binary): row tells texts apart that share a doc_id, and is 0 where no id is met twice."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    unique = source.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    return source.select("doc_id", (F.lit(0) if unique else F.xxhash64("text")).cast("long").alias("row"), "text")


FACTOR = "struct<start: long, end: long, reference: long, place: long>"


def factors(source: DataFrame, window: int = WINDOW, blocks: int | None = None) -> DataFrame:
    """`keyed_rows` -> (doc_id, row, spans: array of FACTOR), rows with duplicates only."""
    import pyarrow as pa

    blocks = blocks or block_count(source)
    packed = packed_windows(source, blocks, window).repartition(blocks, "block").sortWithinPartitions("block")
    owned = owned_windows(packed, blocks).repartition(blocks, "answer").sortWithinPartitions("answer")

    def spans(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        counts = [np.frombuffer(r["counts"], "<u4") for r in rows]
        doc = np.concatenate([np.repeat(np.frombuffer(r["docs"], "<i8"), n) for r, n in zip(rows, counts, strict=True)])
        row = np.concatenate([np.repeat(unpacked_rows(r["rows"], len(n)), n) for r, n in zip(rows, counts, strict=True)])
        at = np.concatenate([np.frombuffer(r["pos"], "<u4") for r in rows]).astype(np.int64)
        owner = np.concatenate([np.frombuffer(r["owner"], "<i8") for r in rows])
        place = np.concatenate([np.frombuffer(r["place"], "<u4") for r in rows]).astype(np.int64)
        order = np.lexsort((owner, at, row, doc))
        doc, row, at, owner, place = doc[order], row[order], at[order], owner[order], place[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))
        once = new | np.concatenate(([True], at[1:] != at[:-1]))  # equal rows have the same windows
        doc, row, at, owner, place, new = doc[once], row[once], at[once], owner[once], place[once], new[once]
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(doc))
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "reference", "place")]))
        for k in range(0, len(first), 5_000):
            found = [[{"start": a, "end": b, "reference": r, "place": p} for a, b, r, p in parse(at[i:j], owner[i:j], place[i:j], window)] for i, j in zip(first[k : k + 5_000], ends[k : k + 5_000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[first[k : k + 5_000]]), pa.array(row[first[k : k + 5_000]]), pa.array(found, kind)], ["doc_id", "row", "spans"])

    return owned.mapInArrow(grouped("answer", spans), f"doc_id long, row long, spans array<{FACTOR}>")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, blocks: int | None = None) -> DataFrame:
    """`docs` (doc_id, text) -> (doc_id, row, spans: array of (start, end, reference, place) in words), rows with duplicates only.

    A span is a factor: its words stand in the reference, a document of smaller id, from word `place` on. Where two
    references meet, spans may overlap. Rows that share a doc_id are told apart by `row`, each has the spans of its own
    text, and none is a reference for another; rows without doc_id are neither compared nor referred to. Null text: no
    words. An empty table gives an empty result; other columns are not looked at. A very long text takes a batch of its own.
    """
    return factors(keyed_rows(docs), window, blocks)


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept binary), row for row: the words outside the spans, joined by one space.

    The texts of documents without a span are not shuffled if the ids of the others can be told to all tasks.
    """
    return cleared(keyed_rows(docs), spans)


def cleared(source: DataFrame, spans: DataFrame) -> DataFrame:
    import pyarrow as pa

    spans = cut(spans)
    key = ["doc_id", "row"]
    ids = spans.select(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            n_words, n_removed, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                gone = covered(len(words), [(s["start"], s["end"]) for s in found or ()])
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(words[i] for i in np.flatnonzero(~gone)) if n_removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    schema = "doc_id long, n_words long, n_removed long, kept binary"
    few = ids.count() <= BROADCAST_IDS
    with_spans = (source.join(F.broadcast(ids), key, "left_semi") if few else source).join(spans, key, "inner" if few else "left")
    parts = [with_spans.select("doc_id", "text", "spans").mapInArrow(run, schema)]
    if few:
        rest = source.join(F.broadcast(ids), key, "left_anti").withColumn("spans", F.lit(None).cast(f"array<{FACTOR}>"))
        parts.append(rest.select("doc_id", "text", "spans").mapInArrow(run, schema))
    return parts[0].unionByName(parts[1]) if few else parts[0]


def op8(docs: DataFrame) -> DataFrame:
    source = keyed_rows(docs)
    done = cleared(source, factors(source))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT n, doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS said FROM (SELECT *, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM docs)),
owned AS (SELECT n, i FROM (SELECT n, i, doc_id, min(doc_id) OVER (PARTITION BY said) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT n, i + k AS pos FROM owned, (SELECT unnest(range({WINDOW})) AS k)),
placed AS (SELECT n, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
kept AS (SELECT n, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS text FROM placed ANTI JOIN gone USING (n, pos) GROUP BY n)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (n)
"""
