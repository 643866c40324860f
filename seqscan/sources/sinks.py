"""Hits as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLES = ("Query number", "Query length", "Query header", "Result number", "Result score", "Reference length", "Reference header", "Reference ID in DB")
FIELDS = ("query_num", "query_length", "query_header", "result_num", "score", "reference_length", "reference_header", "ref_id")


def cell(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def own_file(table: DataFrame) -> list[str]:
    return ["file"] if "file" in table.columns else []


def tsv_lines(hits: DataFrame, anonymous: bool = False) -> DataFrame:
    """([file,] query_num, result_num, line): tab-separated fields, neither quoted nor escaped, without the titles.

    `anonymous` lines have the number -1 and the header `-` instead of the query's.
    """
    fields = [F.lit({"query_num": "-1", "query_header": "-"}[c]) if anonymous and c in ("query_num", "query_header") else cell(c) for c in FIELDS]
    return hits.select(*own_file(hits), "query_num", "result_num", F.concat_ws("\t", *fields).alias("line"))


def query_lines(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """([file,] query_num, result_num, line): a line about each query, its result number -1."""
    file = own_file(queries)
    about = queries.join(stats, [*file, "query_num"], "left")
    head = F.concat(F.lit("Query "), cell("query_num"), F.lit(", header"), cell("header"), F.lit(", length "), F.octet_length(F.coalesce("sequence", F.lit(""))).cast("string"), F.lit(", num overflows "), F.coalesce(F.col("num_overflows"), F.lit(0)).cast("string"))
    return about.select(*file, "query_num", F.lit(-1).alias("result_num"), head.alias("line"))


def result_lines(hits: DataFrame) -> DataFrame:
    """([file,] query_num, result_num, line): a line for each hit."""
    line = F.concat(F.lit("Result "), cell("result_num"), F.lit(". Score: "), cell("score"), F.lit(". Length: "), cell("reference_length"), F.lit(". Header "), cell("reference_header"), F.lit(". referenceId "), cell("ref_id"))
    return hits.select(*own_file(hits), "query_num", "result_num", line.alias("line"))


def plain_lines(hits: DataFrame, queries: DataFrame, stats: DataFrame) -> DataFrame:
    """([file,] query_num, result_num, line): for each query a line about it, numbered -1, then one for each hit."""
    return query_lines(queries, stats).unionByName(result_lines(hits))


def in_order(lines: DataFrame) -> DataFrame:
    """By `place` and file where there are such, then by query and result."""
    return lines.orderBy(*[c for c in ("place", "file", "query_num", "result_num") if c in lines.columns]).select("line")


def write_folder(lines: DataFrame, path: str) -> None:
    """Part files whose names and lines follow the order."""
    in_order(lines).write.text(path)


def write_file(lines: DataFrame, path: str, titles: bool = False, append: bool = False) -> None:
    """One local file (or /dev/stdout), row by row from a partition at a time."""
    with open(path, "a" if append else "w", encoding="utf-8", newline="\n") as out:
        if titles:
            out.write("\t".join(TITLES) + "\n")
        for r in in_order(lines).toLocalIterator():
            out.write(r["line"] + "\n")
