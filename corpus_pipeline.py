"""A training corpus from `documents`: each stage is one of the operators of seqscan.llm, written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seqscan.llm import bpe, mixing, quality, secrets, simhash
from seqscan.sources.folders import shared_folder


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, and boilerplate lines of the others."""
    return quality.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group the document of smallest doc_id stays."""
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: each secret becomes the name of its kind."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mixture has it."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token counts and digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", keep_good_quality),
    ("simhash near-dedup", keep_one_of_each),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("byte-level bpe", tokenize),
]

#: Fingerprints, signatures and the tokenizer's rules are not SQL's; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what goes between them is written in the folder of spark.checkpoint.dir."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{uuid.uuid4()}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
