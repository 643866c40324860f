"""Plain FASTA and FASTQ files of any size, parsed split by split.

What a split's lines mean depends on what stands before it: a line that begins with `@` may be a header or a quality. A
parser in the middle of a file is in one of four states (see `State`), and a split takes each state it may be entered in
to the one it is left in. Three passes over the lines, each in as many tasks as there are splits:

1. Each split tells where it would be left if it began between records, and how much it adds to a sequence or a quality that
   is still open, up to its first line of another kind (`Summary`).
2. From these the states are composed along each file. Where a sum does not decide (a quality that ends inside the split),
   a guess is made, as splits soon fall into step; the second pass parses every split from its composed state and tells
   where that was really left. Guesses that were wrong are replaced and passed again, until all agree. The pass also keeps
   the pieces of records that cross borders; a piece is told by the split in which its record began.
3. The third pass, the result, gives the records that begin and end in a split; those of the pieces put together are added.

The driver holds some numbers for each split, as Spark itself does to plan them: a row for each 128 MB.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import shared_folder
from .records import FormatError, as_text, joined

#: Records of a task that are handed on together, in bytes.
BATCH = 8 << 20
BETWEEN, SEQUENCE, QUALITY, STOPPED = "between", "sequence", "quality", "stopped"
NAMES = ["file", "ordinal", "header", "sequence", "quality"]
SUMMARY = "file string, block long, kind string, origin long, sequence long, quality long, records long, special string, adds long, after_kind string, after_sequence long, after_quality long, after_records long, odd boolean"
PASSED = "file string, block long, kind string, origin long, sequence long, quality long, records long, piece int, record long, header string, residues string, scores string"


@dataclass(frozen=True)
class State:
    """Between records, in a sequence or a quality of so many characters so far, or stopped by an ill-fitting one.

    `origin` is the split in which the open record began.
    """

    kind: str = BETWEEN
    origin: int = -1
    sequence: int = 0
    quality: int = 0


@dataclass(frozen=True)
class Summary:
    """`clear`: left when entered between records, `records` begun then. `special`: the first line that begins with `>`,
    `@` or `+`, by its kind; `adds`: what all lines before it add to an open sequence, all lines to a quality if there is
    none. `after`: left when `special` is a header that is one, with so many records begun. `odd`: its sums depend on
    whether anything was there before."""

    clear: State
    records: int
    special: str
    adds: int
    after: State
    after_records: int
    odd: bool


class Part:
    """What a split has of one record: all of it, or its beginning, middle or end."""

    def __init__(self, header: bytes | None, sequence: int = 0, quality: int | None = None, origin: int = -1):
        self.header, self.residues, self.scores = header, bytearray(), None if quality is None else bytearray()
        self.before, self.scored, self.origin = sequence, quality or 0, origin

    @property
    def length(self) -> int:
        return self.before + len(self.residues)

    @property
    def quality(self) -> int:
        return self.scored + len(self.scores or b"")

    def add(self, line: bytes) -> None:
        grown(self.residues, line, self.before)

    def score(self, line: bytes) -> None:
        grown(self.scores, line, self.scored)


def grown(part: bytearray, line: bytes, before: int) -> None:
    """`joined`, where `before` characters of the whole stand in other splits."""
    if before:
        part += line
        if part and part[-1] == 13 and line:
            del part[-1]
    else:
        joined(part, line)


class Walker:
    """Takes the lines of a split one by one and gives the parts of records that end with them."""

    def __init__(self, entry: State, block: int):
        self.block, self.stopped, self.begun, self.now = block, entry.kind == STOPPED, 0, None
        if entry.kind in (SEQUENCE, QUALITY):
            self.now = Part(None, entry.sequence, entry.quality if entry.kind == QUALITY else None, entry.origin)

    def take(self, line: bytes) -> Part | None:
        """The record that ends with this line, or before it; `stopped` is set where its quality does not fit."""
        now, done = self.now, None
        if self.stopped:
            return None
        if now is None:
            start = min((p for p in (line.find(b">"), line.find(b"@")) if p >= 0), default=-1)
            if start >= 0:
                self.begin(line[start + 1 :])
        elif now.scores is not None:
            now.score(line)
            if now.quality >= now.length:
                done, self.now, self.stopped = now, None, now.quality != now.length
        elif line[:1] in (b">", b"@"):
            done = now
            self.begin(line[1:])
        elif line[:1] == b"+":
            now.scores = bytearray()
        elif line:
            now.add(line)
        return done

    def begin(self, header: bytes) -> None:
        whole = bytearray()
        joined(whole, header)
        self.now = Part(bytes(whole), origin=self.block)
        self.begun += 1

    def state(self) -> State:
        if self.stopped:
            return State(STOPPED)
        now = self.now
        return State() if now is None else State(SEQUENCE if now.scores is None else QUALITY, now.origin, now.length, now.quality)


def summed(lines: Iterator[bytes], block: int) -> Summary:
    clear, later = Walker(State(), block), None
    special, adds, odd = "", 0, False
    for line in lines:
        if not special:
            if line[:1] in (b">", b"@"):
                # Between records a header begins one too, so the two go on alike.
                special, later = "header", clear if clear.now is None else Walker(State(), block)
            elif line[:1] == b"+":
                special = "quality"
            else:
                adds += len(line) - line.endswith(b"\r")
                odd = odd or line == b"\r"
        clear.take(line)
        if later is not None and later is not clear:
            later.take(line)
    return Summary(clear.state(), clear.begun, special, adds, later.state() if later else State(), later.begun if later else 0, odd)


def composed(entry: State, split: Summary) -> tuple[State, int, bool]:
    """The state a split is left in, the records begun in it, and whether that is sure."""
    if entry.kind == STOPPED:
        return entry, 0, True
    if entry.kind == BETWEEN:
        return split.clear, split.records, True
    if entry.kind == SEQUENCE and not (split.odd and not entry.sequence):
        if not split.special:
            return replace(entry, sequence=entry.sequence + split.adds), 0, True
        if split.special == "header":
            return split.after, split.after_records, True
    if entry.kind == QUALITY and not split.special and not split.odd and split.adds < entry.sequence - entry.quality:
        return replace(entry, quality=entry.quality + split.adds), 0, True
    return split.clear, split.records, False


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """Lines (file, block, value) of each split, as they come."""
    told = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value")), strict=True))
    for (file, block), own in groupby(told, key=lambda x: x[:2]):
        yield file, block, (line for _, _, line in own)


def lines_of_splits(spark: SparkSession, where: list[str]) -> DataFrame:
    """(file, block, value): the lines of plain files, in order within each split."""
    file = F.regexp_replace("_metadata.file_path", "^file:///", "file:/")
    lines = spark.read.option("lineSep", "\n").text(where)
    return lines.select(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def summaries(lines: DataFrame) -> dict[tuple[str, int], Summary]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, own in by_split(batches):
            s = summed(list(own), block)
            row = (file, block, s.clear.kind, s.clear.origin, s.clear.sequence, s.clear.quality, s.records, s.special, s.adds, s.after.kind, s.after.sequence, s.after.quality, s.after_records, s.odd)
            yield pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in SUMMARY.split(", ")), row, strict=True))])

    found = {}
    for r in lines.mapInArrow(run, SUMMARY).toLocalIterator():
        after = State(r["after_kind"], r["block"] if r["after_kind"] in (SEQUENCE, QUALITY) else -1, r["after_sequence"], r["after_quality"])
        found[r["file"], r["block"]] = Summary(State(r["kind"], r["origin"], r["sequence"], r["quality"]), r["records"], r["special"], r["adds"], after, r["after_records"], r["odd"])
    return found


def entries(splits: dict[tuple[str, int], Summary], known: dict[tuple[str, int, State], tuple[State, int]]) -> dict[tuple[str, int], tuple[State, int]]:
    """The state each split is entered in and the records begun before it, from summaries and what passes have told."""
    out, file, state, records = {}, None, State(), 0
    for key in sorted(splits):
        if key[0] != file:
            file, state, records = key[0], State(), 0
        out[key] = state, records
        after, n = known.get((*key, state)) or composed(state, splits[key])[:2]
        state, records = after, records + n
    return out


def passed(lines: DataFrame, told) -> DataFrame:
    """Each split from the state told: how it was left (piece -1), and its pieces of records that cross its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PASSED.split(", ")]
        for file, block, own in by_split(batches):
            entry, before = told.value[file, block]
            walker, pieces = Walker(entry, block), []
            for line in own:
                done = walker.take(line)
                if done is not None and (done.header is None or walker.stopped):
                    pieces.append(done)
                if walker.stopped:
                    break
            pieces += [walker.now] if walker.now is not None else []
            end = walker.state()
            rows = [(file, block, end.kind, end.origin, end.sequence, end.quality, walker.begun, -1, None, None, None, None)]
            for piece in pieces:
                # The record that was open when the split began is the last one before it; the others are the last begun.
                number = before - 1 if piece.header is None else before + walker.begun - 1
                text = lambda x: None if x is None else x.decode("latin-1")
                rows.append((file, block, None, piece.origin, piece.before, piece.scored, None, 0, number, None if piece.header is None else as_text(piece.header), text(piece.residues), text(piece.scores)))
            kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int64(), *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return lines.mapInArrow(run, PASSED)


def whole_records(lines: DataFrame, told, permissive: bool) -> DataFrame:
    """Records that begin and end in one split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def flush(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

        for file, block, own in by_split(batches):
            if (file, block) not in told.value:
                raise RuntimeError(f"{file} was cut into other splits than before: it or spark.sql.files.maxPartitionBytes has changed")
            entry, ordinal = told.value[file, block]
            walker, rows, size = Walker(entry, block), [], 0
            for line in own:
                done = walker.take(line)
                if walker.stopped:
                    if done is not None and not permissive:
                        raise FormatError(f"record {bytes(done.header or b'...')!r}: quality of {done.quality} characters for {done.length} residues")
                    break
                if done is None or done.header is None:
                    continue
                rows.append((file, ordinal, as_text(done.header), done.residues.decode("latin-1"), None if done.scores is None else done.scores.decode("latin-1")))
                ordinal += 1
                size += len(done.residues) + 64
                if size > BATCH:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)

    return lines.mapInArrow(run, ", ".join(f"{n} {'long' if n == 'ordinal' else 'string'}" for n in NAMES))


def put_together(pieces: DataFrame, permissive: bool) -> DataFrame:
    """Records of pieces, in order of their splits; two or a few for each border between splits."""
    listed = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "header", "residues", "scores"))).alias("parts"))
    text = lambda field: F.array_join(F.transform("parts", lambda p: F.coalesce(p[field], F.lit(""))), "")
    scored = F.exists("parts", lambda p: p["scores"].isNotNull())
    made = listed.select("file", F.col("record").alias("ordinal"), F.element_at("parts", 1)["header"].alias("header"), text("residues").alias("sequence"), F.when(scored, text("scores")).alias("quality"))
    fits = F.col("quality").isNull() | (F.length("quality") == F.length("sequence"))
    if permissive:
        return made.where(fits)
    said = F.concat(F.lit("record "), "header", F.lit(": quality of "), F.length("quality"), F.lit(" characters for "), F.length("sequence"), F.lit(" residues"))
    return made.withColumn("header", F.when(fits, F.col("header")).otherwise(F.raise_error(said)))


def read_split(spark: SparkSession, where: list[str], permissive: bool = False) -> DataFrame:
    """Records (file, ordinal, header, sequence, quality) of plain files, whatever their size and however they are split."""
    lines = lines_of_splits(spark, where)
    splits = summaries(lines)
    known: dict[tuple[str, int, State], tuple[State, int]] = {}
    pieces = None
    while pieces is None:
        found = entries(splits, known)
        told = spark.sparkContext.broadcast(found)
        path = f"{shared_folder(spark)}/{uuid.uuid4()}"
        passed(lines, told).write.parquet(path)
        rows = spark.read.schema(PASSED).parquet(path)
        for r in rows.where("piece = -1").toLocalIterator():
            known[r["file"], r["block"], found[r["file"], r["block"]][0]] = State(r["kind"], r["origin"], r["sequence"], r["quality"]), r["records"]
        if entries(splits, known) == found:
            pieces = rows.where("piece = 0").select("file", "block", "record", "header", "residues", "scores")
    return whole_records(lines, told, permissive).unionByName(put_together(pieces, permissive))
