"""Sequence files as DataFrames: (file, ordinal, header, sequence, quality)."""

from __future__ import annotations

import glob as paths
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .records import as_text, inflated_lines, lines_of, parse, records_of
from .splits import read_split

SCHEMA = "file string, ordinal long, header string, sequence string, quality string"


#: A larger file (bytes) is not read whole but line by line.
LARGE = 256 << 20
#: Residues of the records that are handed on together.
BATCH = 8 << 20
NAMES = ["file", "ordinal", "header", "sequence", "quality"]


def batches_of(found: Iterator[tuple[str, int, tuple[bytes, bytes, bytes | None]]]) -> Iterator:
    """(file, ordinal, record) as Arrow batches of bounded size."""
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)
    rows: list[tuple] = []
    size = 0
    for file, n, (header, sequence, quality) in found:
        rows.append((file, n, as_text(header), sequence.decode("latin-1"), None if quality is None else quality.decode("latin-1")))
        size += len(sequence) + len(header) + 64
        if size > BATCH:
            yield as_batch(rows)
            rows, size = [], 0
    if rows:
        yield as_batch(rows)


def parsed(files: DataFrame, permissive: bool = False) -> DataFrame:
    """Rows of Spark's binaryFile source (path, content) -> records, in order within each file."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                records = parse(content.as_py(), permissive)
                yield from batches_of((path.as_py(), n, r) for n, r in enumerate(records))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def parsed_lines(lines: DataFrame, permissive: bool = False) -> DataFrame:
    """`lines` (file, value), each file's together and in order -> records. A task holds one record at a time."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = ((file, line) for batch in batches for file, line in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True))
        files = groupby(told, key=lambda x: x[0])
        yield from batches_of((file, n, r) for file, own in files for n, r in enumerate(records_of((line for _, line in own), permissive)))

    return lines.select("file", F.col("value").cast("binary").alias("value")).mapInArrow(run, SCHEMA)


#: Suffixes by which Spark would take a file for compressed.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")


def is_gzip(spark: SparkSession, path: str) -> bool:
    """By the first two bytes, read through Spark's file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return (stream.read(), stream.read()) == (0x1F, 0x8B)
    finally:
        stream.close()


def as_they_are(spark: SparkSession, where: list[str], suffix: str | None = None) -> DataFrame:
    """(file, size, value): lines of files. Those that end in `suffix` are read in one task each, in order, and not inflated
    whatever their names say. Files without a suffix may be split; their lines are brought in order by a shuffle that spills."""
    reader = spark.read.option("lineSep", "\n")
    if suffix:
        codec = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
        reader = reader.option("io.compression.codecs", codec.CLASSNAME).option(codec.OPT_EXTENSION, suffix)
    file = F.regexp_replace("_metadata.file_path", "^file:///", "file:/")
    lines = reader.text(where).select(file.alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), "value")
    if suffix == "":
        lines = lines.withColumn("at", F.monotonically_increasing_id()).repartition("file").sortWithinPartitions("file", "block", "at")
    return lines.select("file", "size", "value")


def parsed_packed(lines: DataFrame, permissive: bool = False) -> DataFrame:
    """Lines (file, size, value) of gzip files taken as they are -> records, inflated by a task for each file as it reads."""
    import pyarrow as pa

    def content(lines: Iterator[tuple[int, bytes]]) -> Iterator[bytes]:
        read, first = 0, True
        for size, line in lines:
            piece = line if first else b"\n" + line
            read, first = read + len(piece), False
            yield piece
        if not first and read < size:
            yield b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("file", "size", "value")), strict=True))
        for file, own in groupby(told, key=lambda x: x[0]):
            lines = inflated_lines(content((size, line) for _, size, line in own))
            yield from batches_of((file, n, r) for n, r in enumerate(records_of(lines, permissive)))

    return lines.select("file", "size", F.col("value").cast("binary").alias("value")).mapInArrow(run, SCHEMA)


def read_lines(spark: SparkSession, where: list[str], permissive: bool = False) -> DataFrame:
    """Records of files of any size, gzipped or not as their first bytes say, whatever they are called.

    Plain files are parsed split by split. Gzip can't be split: a task reads a file, inflates as it reads and holds a
    record. So does the task of a plain file with a compressed one's name, which Spark does not split.
    """
    with ThreadPoolExecutor(16) as pool:
        packed = dict(zip(where, pool.map(lambda p: is_gzip(spark, p), where), strict=True))
    last = lambda p: os.path.splitext(p)[1]
    found = []
    if named := [p for p in where if packed[p] and p.endswith(".gz")]:
        found.append(parsed_lines(as_they_are(spark, named), permissive))
    for suffix in sorted({last(p) for p in where if packed[p] and not p.endswith(".gz")}):
        found.append(parsed_packed(as_they_are(spark, [p for p in where if packed[p] and last(p) == suffix], suffix), permissive))
    for suffix in sorted({last(p) for p in where if not packed[p] and p.endswith(PACKED)}):
        found.append(parsed_lines(as_they_are(spark, [p for p in where if not packed[p] and last(p) == suffix], suffix), permissive))
    if plain := [p for p in where if not packed[p] and not p.endswith(PACKED)]:
        found.append(read_split(spark, plain, permissive))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def read_sequences(spark: SparkSession, *where: str, permissive: bool = False, large: int = LARGE) -> DataFrame:
    """FASTA and FASTQ files (paths, folders or globs in any file system Spark reads), gzipped or not by their content.

    A file of up to `large` bytes is read whole by one task and inflated as it is parsed. Larger ones go through `read_lines`.
    """
    files = spark.read.format("binaryFile").load(list(where))
    long = [r["path"] for r in files.where(F.col("length") > large).select("path").toLocalIterator()]
    small = parsed(files.where(F.col("length") <= large), permissive)
    return small.unionByName(read_lines(spark, long, permissive)) if long else small


def read_large_fasta(spark: SparkSession, *where: str) -> DataFrame:
    """Plain FASTA files of any size, split among tasks at record borders (`>` at the beginning of a line).

    For files that hold nothing but FASTA and begin with a record. The ordinal grows along a file but has gaps.
    """
    lines = spark.read.option("lineSep", "\n>").text(list(where)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    place = F.col("block") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    cut = lines.select("file", place.alias("ordinal"), F.regexp_replace("value", "^>", "").alias("value")).where("value != ''")
    header = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")
    rest = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return cut.select("file", "ordinal", header.alias("header"), F.regexp_replace(rest, "[\r\n]", "").alias("sequence"), F.lit(None).cast("string").alias("quality"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.where, self.permissive = options["path"], options.get("mode", "").upper() == "PERMISSIVE"

    def partitions(self):
        found = sorted(paths.glob(self.where))
        files = [f for p in found for f in (sorted(os.path.join(p, x) for x in os.listdir(p)) if os.path.isdir(p) else [p])]
        if not files:
            raise FileNotFoundError(self.where)
        return [_File(f) for f in files]

    def read(self, partition):
        with open(partition.path, "rb") as source:
            for n, (header, sequence, quality) in enumerate(records_of(lines_of(source), self.permissive)):
                yield partition.path, n, as_text(header), sequence.decode("latin-1"), None if quality is None else quality.decode("latin-1")


class FastaSource(DataSource):
    """`spark.read.format("fasta").load(path)` over files that all executors see under that path."""

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)


def pairs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Mates in lockstep: neighbours of one scan, file by file, or records with the same ordinal of two scans.

    The files of two scans are mates in order of their names: the first of the one with the first of the other. Files
    without a mate have no pairs, nor have records beyond the end of the shorter file.
    """
    if right is None:
        first = left.where("ordinal % 2 = 0").withColumn("pair", F.expr("ordinal div 2"))
        second = left.where("ordinal % 2 = 1").withColumn("pair", F.expr("ordinal div 2"))
        on = ["file", "pair"]
    else:
        first, second, on = in_file_order(left), in_file_order(right), ["file_idx", "pair"]
    named = lambda df, n: df.select(*on, *[F.col(c).alias(f"{c}_{n}") for c in ("header", "sequence", "quality")])
    return named(first, 1).join(named(second, 2), on)


def in_file_order(records: DataFrame) -> DataFrame:
    """With `file_idx`, the place of a record's file in order of names, and `pair`, its ordinal there."""
    files = records.select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("file_idx"))
    return records.join(F.broadcast(files) if files.limit(100_001).count() <= 100_000 else files, "file").withColumn("pair", F.col("ordinal"))


def skip(records: DataFrame, n: int) -> DataFrame:
    """Records after the first `n` of each file."""
    return records.where(F.col("ordinal") >= n)
