"""The sequence database: encoded subjects in order of length, as Parquet split by length bucket."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqscan.functions import residues
from seqscan.functions.registry import aa_decode, aa_encode
from seqscan.functions.residues import length_partition, padded_length

#: Input positions that one task numbers.
ORDINALS = 1 << 16
LIMIT = 2**31 - 1 - 128 - 4


def with_ref_ids(records: DataFrame, length: str = "length", ordinal: str = "ordinal") -> DataFrame:
    """Dense numbers from 0 in order of (length, file, ordinal), as `ref_id`; of (length, ordinal) for records without `file`.

    Numbers within a block of input positions of one length and file are added to the count of what comes before the block;
    so neither the table nor the records of one length meet in a task. More than 2^31 records are refused.
    """
    file = F.coalesce("file", F.lit("")) if "file" in records.columns else F.lit("")
    blocked = records.withColumn("__file", file).withColumn("__block", F.expr(f"{ordinal} div {ORDINALS}"))
    counts = blocked.groupBy(F.col(length).alias("__l"), F.col("__file").alias("__f"), F.col("__block").alias("__b")).agg(F.count("*").alias("__n"))
    lengths = counts.groupBy("__l").agg(F.sum("__n").alias("__n"))
    before_length = lengths.select(F.col("__l").alias("__k"), (F.sum("__n").over(Window.orderBy("__l")) - F.col("__n")).alias("__shorter"))
    before_block = counts.select("__l", "__f", "__b", (F.sum("__n").over(Window.partitionBy("__l").orderBy("__f", "__b")) - F.col("__n")).alias("__earlier"))
    offsets = before_block.join(before_length, F.col("__l") == F.col("__k")).select("__l", "__f", "__b", (F.col("__shorter") + F.col("__earlier")).alias("__offset"))
    numbered = blocked.withColumn("__at", F.row_number().over(Window.partitionBy(length, "__file", "__block").orderBy(ordinal)))
    joined = numbered.join(offsets, (F.col(length) == F.col("__l")) & (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    place = F.col("__offset") + F.col("__at") - 1
    few = F.when(place < 2**31, place).otherwise(F.raise_error(F.lit("more than 2^31 sequences")).cast("long"))
    return joined.select(*records.columns, few.cast("int").alias("ref_id"))


def sized(records: DataFrame) -> DataFrame:
    """([file,] ordinal, header, sequence) with length and length_partition, enough for statistics. Null sequences are empty."""
    whole = records.select(*[c for c in ("file",) if c in records.columns], "ordinal", "header", F.coalesce("sequence", F.lit("")).alias("sequence"))
    whole = whole.withColumn("length", F.octet_length("sequence").cast("int"))
    return whole.withColumn("length_partition", length_partition(F.col("length")))


def subjects(records: DataFrame) -> DataFrame:
    """([file,] ordinal, header, sequence) -> (ref_id, length, length_partition, header, residues)."""
    numbered = with_ref_ids(sized(records))
    return numbered.select("ref_id", "length", "length_partition", "header", aa_encode("sequence").alias("residues"))


def build_db(records: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the database of `records` ([file,] ordinal, header, sequence) to a new folder, with a manifest beside the table."""
    table = subjects(records)
    dealt = table.repartitionByRange(*([partitions] if partitions else []), "length", "ref_id").sortWithinPartitions("length", "ref_id")
    dealt.write.partitionBy("length_partition").parquet(f"{path}/subjects")
    spark = records.sparkSession
    info = db_info(spark.read.parquet(f"{path}/subjects")).first().asDict()
    counts = {str(r["length_partition"]): r["num_sequences"] for r in length_histogram(spark.read.parquet(f"{path}/subjects")).collect()}
    manifest = {"version": 1, "alphabet": residues.ALPHABET, "boundaries": list(residues.BOUNDS), "counts": counts, **info}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load_db(spark: SparkSession, path: str) -> DataFrame:
    """The subjects of a database; one that was not written to its end has no manifest and is refused."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:
        raise FileNotFoundError(f"no sequence database at {path}") from e
    if manifest["alphabet"] != residues.ALPHABET or tuple(manifest["boundaries"]) != residues.BOUNDS:
        raise ValueError(f"the database at {path} was made for another alphabet or other length buckets")
    table = spark.read.schema("ref_id int, length int, header string, residues binary, length_partition int").parquet(f"{path}/subjects")
    return table.select("ref_id", "length", "length_partition", "header", "residues")


def pseudo_residues(length: int, seed: int = 42) -> bytes:
    draw = random.Random(seed)
    return bytes(draw.randrange(20) for _ in range(length))


def pseudo_db(spark: SparkSession, num: int, length: int, seed: int = 42) -> DataFrame:
    """`num` subjects that are all the same random sequence, headed `H`."""
    one = pseudo_residues(length, seed)
    return spark.range(num).select(F.col("id").cast("int").alias("ref_id"), F.lit(length).cast("int").alias("length"), length_partition(F.lit(length)).alias("length_partition"), F.lit("H").alias("header"), F.lit(bytearray(one)).alias("residues"))


def db_info(db: DataFrame) -> DataFrame:
    """One row: sequences, residues as padded to four, least, greatest and mean length (whole division)."""
    length = F.col("length").cast("long")
    return db.agg(
        F.count("*").alias("num_sequences"),
        F.coalesce(F.sum(padded_length(length)), F.lit(0)).cast("long").alias("num_chars"),
        F.coalesce(F.min("length"), F.lit(0)).cast("int").alias("min_length"),
        F.coalesce(F.max("length"), F.lit(0)).cast("int").alias("max_length"),
        F.coalesce(F.expr("sum(length) div count(*)"), F.lit(0)).cast("long").alias("avg_length"),
    )


def length_histogram(db: DataFrame) -> DataFrame:
    """All 36 buckets with their bounds and numbers of sequences, empty ones too."""
    buckets = db.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, residues.BOUNDS))).alias("length_partition", "upper_bound"))
    counts = db.groupBy("length_partition").agg(F.count("*").alias("n"))
    return F.broadcast(buckets).join(counts, "length_partition", "left").select("length_partition", "upper_bound", F.coalesce("n", F.lit(0)).cast("long").alias("num_sequences"))


def partition_prefix_sums(db: DataFrame) -> DataFrame:
    """Of each bucket, the first row number in order of length."""
    over = Window.orderBy("length_partition")
    return length_histogram(db).select("length_partition", "num_sequences", (F.sum("num_sequences").over(over) - F.col("num_sequences")).cast("long").alias("first_row"))


def residue_offsets(db: DataFrame) -> DataFrame:
    """(ref_id, start): where a subject would begin in one array of all residues padded to four."""
    blocked = db.select("ref_id", padded_length(F.col("length")).alias("size"), F.expr(f"ref_id div {ORDINALS}").alias("block"))
    sums = blocked.groupBy("block").agg(F.sum("size").alias("n"))
    ahead = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("ahead"))
    within = Window.partitionBy("block").orderBy("ref_id").rowsBetween(Window.unboundedPreceding, 0)
    return blocked.withColumn("upto", F.sum("size").over(within)).join(ahead, "block").select("ref_id", (F.col("ahead") + F.col("upto") - F.col("size")).cast("long").alias("start"))


def lookup(db: DataFrame, wanted: DataFrame) -> DataFrame:
    """Headers, lengths and decoded letters of the subjects whose ref_id is in `wanted`. Letters of other bytes are `-`."""
    return db.join(wanted.select("ref_id").distinct(), "ref_id").select("ref_id", "length", "header", aa_decode("residues").alias("sequence"))


def recode(db: DataFrame) -> DataFrame:
    """Residues taken as letters and encoded (again): on an encoded database everything becomes `other`."""
    return db.withColumn("residues", aa_encode(F.decode("residues", "iso-8859-1")))


def lengths_as(db: DataFrame, kind: str) -> DataFrame:
    """(ref_id, length) with the length as int or bigint."""
    if kind not in ("int", "bigint"):
        raise ValueError("kind is int or bigint")
    return db.select("ref_id", F.col("length").cast(kind).alias("length"))
