"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, collocations, disclosure, html, licenses, media, mixing, quality, repair, secrets, simhash, substring
from .common import table


def on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": on("pages", html.op1),
        "op2_source_mixing": on("documents", mixing.op2),
        "op3_simhash_near_dedup": on("documents", simhash.op3),
        "op4_chat_formatting": on("conversations", chat.op4),
        "op5_secret_scans": on("documents", secrets.op5),
        "op6_media_columns": on("documents", media.op6),
        "op7_quality_rules": on("documents", quality.op7),
        "op8_substring_dedup": on("documents", substring.op8),
        "op9_byte_level_bpe": on("documents", bpe.op9),
        "op10_license_scans": on("documents", licenses.op10),
        "op11_phrase_collocations": on("documents", collocations.op11),
        "op12_pii_sanitisation": on("documents", disclosure.op12),
        "op13_conversation_repair": on("conversations", repair.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mixing": mixing.oracle(),
        "op4_chat_formatting": chat.ORACLE,
        "op5_secret_scans": secrets.oracle(),
        "op7_quality_rules": quality.ORACLE,
        "op8_substring_dedup": substring.ORACLE,
        "op10_license_scans": licenses.oracle(),
        "op11_phrase_collocations": collocations.ORACLE,
        "op12_pii_sanitisation": disclosure.ORACLE,
        "op13_conversation_repair": repair.ORACLE,
    }
