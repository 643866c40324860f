"""Command line: build a database, search it, ask about it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqscan.operators import database
from seqscan.operators.search import search
from seqscan.plans.config import KERNELS, SearchConfig, parse_size
from seqscan.sources import sinks
from seqscan.sources.fasta import read_sequences
from seqscan.streaming.live import Answer, Dialogue, Session, numbered


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqscan")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="make a database of FASTA or FASTQ files, gzipped or not")
    build.add_argument("input")
    build.add_argument("output")
    build.add_argument("--mem", type=parse_size, help="accepted, without effect")
    build.add_argument("--tempdir", help="accepted, without effect")
    align = commands.add_parser("search", help="search a database")
    align.add_argument("--query", action="append", default=[], help="query file; may be given more than once")
    align.add_argument("--db", help="database folder")
    align.add_argument("--pseudodb", nargs=2, type=int, metavar=("NUM", "LENGTH"), help="equal random subjects instead of a database")
    align.add_argument("--top", type=int, default=10)
    align.add_argument("--mat", default="blosum62")
    align.add_argument("--gop", type=int)
    align.add_argument("--gex", type=int)
    align.add_argument("--tsv", action="store_true", help="tab-separated output")
    align.add_argument("--of", default="/dev/stdout", help="output file")
    align.add_argument("--interactive", action="store_true")
    align.add_argument("--verbose", action="store_true")
    align.add_argument("--printLengthPartitions", action="store_true")
    align.add_argument("--prefetchDBFile", action="store_true", help="read the database into memory first")
    align.add_argument("--dpx", action="store_true")
    for name in ("singlePassType", "manyPassType_small", "manyPassType_large", "overflowType"):
        align.add_argument(f"--{name}", choices=KERNELS, type=str.lower)
    for name in ("maxBatchBytes", "maxBatchSequences", "maxTempBytes", "maxGpuMem"):
        align.add_argument(f"--{name}", type=parse_size, help="accepted, without effect")
    align.add_argument("--uploadFull", action="store_true", help="accepted, without effect")
    info = commands.add_parser("info", help="statistics of a database")
    info.add_argument("db")
    return top


def config_of(args: argparse.Namespace) -> SearchConfig:
    kinds = {"single_pass": args.singlePassType, "many_pass_small": args.manyPassType_small, "many_pass_large": args.manyPassType_large, "overflow": args.overflowType}
    rest = {"top": args.top, "matrix": args.mat, "gop": args.gop, "gex": args.gex}
    return SearchConfig.dpx(**rest) if args.dpx else SearchConfig(**rest, **{k: v for k, v in kinds.items() if v})


def converse(talk: Dialogue, path: str) -> None:
    """Answers the lines of standard input: what is said goes to standard output, results to one file."""
    written = False

    def give(answer: Answer | None) -> None:
        nonlocal written
        if answer:
            print("\n".join(answer.said), flush=True)
            if answer.lines is not None:
                sinks.write_file(answer.lines, path, titles=talk.tsv and not written, append=written)
                written = True

    for line in sys.stdin:
        give(talk.take(line))
        if talk.over:
            return
    give(talk.end())


def run_search(spark: SparkSession, args: argparse.Namespace) -> int:
    config = config_of(args)
    if not (args.db or args.pseudodb) or not (args.query or args.interactive):
        print("a database and a query are needed", file=sys.stderr)
        return 2
    db = database.pseudo_db(spark, *args.pseudodb) if args.pseudodb else database.load_db(spark, args.db)
    if args.prefetchDBFile:
        db = db.persist()
        db.count()
    if args.verbose:
        print(config.explain(), file=sys.stderr)
        print(database.db_info(db).first(), file=sys.stderr)
        if args.printLengthPartitions:
            for r in database.length_histogram(db).orderBy("length_partition").toLocalIterator():
                print(f"<= {r.upper_bound}: {r.num_sequences}", file=sys.stderr)
    if args.interactive:
        converse(Dialogue(Session(db, config), args.tsv), args.of)
        return 0
    lines, kept = None, []
    for k, path in enumerate(args.query):
        queries = numbered(read_sequences(spark, path))
        result = search(queries, db, config).timed()
        kept.append(result.candidates)
        if args.verbose:
            print(result.metrics().first(), file=sys.stderr)
        if config.top:
            found = sinks.tsv_lines(result.hits()) if args.tsv else sinks.plain_lines(result.hits(), queries, result.stats())
            found = found.withColumn("place", F.lit(k))
            lines = found if lines is None else lines.unionByName(found)
    if lines is not None:
        sinks.write_file(lines, args.of, titles=args.tsv)
    for candidates in kept:
        candidates.unpersist()
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("seqscan").getOrCreate()
    if args.command == "build":
        database.build_db(read_sequences(spark, args.input), args.output)
        return 0
    if args.command == "info":
        print(database.db_info(database.load_db(spark, args.db)).first())
        return 0
    return run_search(spark, args)


if __name__ == "__main__":
    sys.exit(main())
