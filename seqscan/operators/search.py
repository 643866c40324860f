"""Search: every query against every subject, the best `top` subjects of each query."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqscan.functions import residues
from seqscan.functions.scoring import BEYOND, BOUNDED, all_scores, bounds_fit, pair_scores, slack, upper_bounds
from seqscan.plans.config import SearchConfig
from seqscan.sources.folders import shared_folder

#: Bytes of queries that are told to all tasks at most; more are dealt with the database in cells.
QUERY_BYTES = 1 << 20
#: Bytes of queries and of subjects in a cell, about; a core takes some minutes for it.
QUERY_BLOCK, SLICE = 64 << 10, 4 << 20
MOST_TASKS = 50_000
#: A longer query is refused.
LIMIT = 2**31 - 1 - 128 - 4
#: Subjects' residues that a task scores at once; more where queries are bounded, as strips of similar length are then wider.
SUBJECT_BLOCK, WIDE_BLOCK = 2 << 20, 16 << 20
#: Scores that a task works out at once.
MOST_SCORES = 16 << 20
#: Bounds of a query that leave a task, beyond those of 4 * top subjects; where more are near, the task scores them.
UNSETTLED = 64
#: Residues for a task under which a database is dealt anew.
SMALL_TASK = 32 << 20
CANDIDATES = "file string, query_num long, ref_id int, score int, cells long, overflows long"
#: `slack`: the score is a bound, this much too high at most.
ROUGH = f"{CANDIDATES}, slack int"
HITS = ["query_num", "query_length", "query_header", "result_num", "score", "reference_length", "reference_header", "ref_id"]


def best(refs: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the best rows: score from high to low, ref_id from low to high."""
    if len(scores) > top:
        edge = np.partition(scores, len(scores) - top)[len(scores) - top]
        rows = np.flatnonzero(scores >= edge)
    else:
        rows = np.arange(len(scores))
    return rows[np.lexsort((refs[rows], -scores[rows]))][:top]


def near(refs: np.ndarray, scores: np.ndarray, loose: np.ndarray, top: int) -> np.ndarray:
    """Places of the rows that may be among the best, where scores are up to `loose` too high."""
    sure = scores - loose
    if len(sure) > top:
        scores_upto = np.partition(sure, len(sure) - top)[len(sure) - top]
        rows = np.flatnonzero(scores >= scores_upto)
    else:
        rows = np.arange(len(scores))
    known = loose[rows] == 0
    settled = rows[known]
    return np.concatenate((settled[best(refs[settled], scores[settled], top)], rows[~known]))


def bounded(config: SearchConfig, length: int) -> bool:
    """Whether a query of this length is bounded first, and only what may be among the best is scored."""
    return BOUNDED[0] <= length <= BOUNDED[1] and bounds_fit(residues.matrix(config.matrix), *config.gaps)


class Tally:
    """The best subjects of some queries among those seen so far, and the queries' cells and overflows."""

    def __init__(self, queries: list[tuple[str | None, int, bytes]], config: SearchConfig):
        self.files, self.numbers, self.codes = [f for f, _, _ in queries], [n for _, n, _ in queries], [residues.encode(s) for _, _, s in queries]
        self.table, self.gaps, self.rules, self.top = residues.matrix(config.matrix), config.gaps, config.overflow_rules, config.top
        self.rough = [k for k, c in enumerate(self.codes) if bounded(config, len(c))]
        self.exact = sorted(set(range(len(self.codes))) - set(self.rough))
        self.kept = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)) for _ in queries]
        self.residues, self.overflows = 0, np.zeros(len(queries), np.int64)
        self.refs: list[int] = []
        self.texts: list[bytes] = []
        self.waiting = 0

    def add(self, ref: int, codes: bytes | None) -> None:
        self.refs.append(ref)
        self.texts.append(codes or b"")
        self.waiting += len(self.texts[-1])
        most = min(50_000, max(1, MOST_SCORES // max(1, len(self.codes))))
        if self.waiting > (WIDE_BLOCK if self.rough else SUBJECT_BLOCK) or len(self.refs) >= most:
            self.score()

    def score(self) -> None:
        """Score the subjects that wait; equal ones once."""
        texts = list(dict.fromkeys(self.texts))
        place = {t: i for i, t in enumerate(texts)}
        which = np.array([place[t] for t in self.texts])
        lengths = np.array([len(t) for t in texts])
        bucket, copies = np.searchsorted(residues.BOUNDS, lengths), np.bincount(which)
        self.residues += int(lengths @ copies)
        ids = np.array(self.refs, np.int64)
        # Of equal subjects none but the first `top` can be among the best.
        order = np.lexsort((ids, which))
        nth = np.arange(len(order)) - np.repeat(np.cumsum(copies) - copies, copies)
        order = order[nth < self.top]
        ids, which = ids[order], which[order]
        for part, given in ((self.exact, all_scores), (self.rough, upper_bounds)):
            if not part:
                continue
            found = given([self.codes[k] for k in part], texts, self.table, *self.gaps)
            for k, values in zip(part, found, strict=True):
                self.take(k, texts, values, given is upper_bounds, bucket, copies, ids, which)
        self.refs, self.texts, self.waiting = [], [], 0

    def take(self, k: int, texts: list[bytes], values: np.ndarray, loose: bool, bucket: np.ndarray, copies: np.ndarray, ids: np.ndarray, which: np.ndarray) -> None:
        """Keep of one query's scores (or bounds) what may be among the best, and count overflows."""
        off = slack(values, *self.gaps).astype(np.int32) if loose else np.zeros(len(values), np.int32)

        def settle(rows: np.ndarray) -> None:
            rows = rows[off[rows] > 0]
            if len(rows):
                values[rows], off[rows] = pair_scores([(self.codes[k], texts[i]) for i in rows], self.table, *self.gaps), 0

        settle(np.flatnonzero(values == BEYOND))
        for first, last, threshold in self.rules:
            over = (values >= threshold) & (bucket >= first) & (bucket <= last)
            settle(np.flatnonzero(over))
            self.overflows[k] += copies[over & (values >= threshold)].sum()
        if not self.top:
            return
        old = len(self.kept[k][0])

        def together() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(self.kept[k], (ids, values[which], off[which]), strict=True))

        kept = together()
        rows = near(*kept, self.top)
        if (kept[2][rows] > 0).sum() > 4 * self.top + UNSETTLED:
            settle(np.unique(which[rows[rows >= old] - old]))
            kept = together()
            rows = near(*kept, self.top)
        self.kept[k] = tuple(x[rows] for x in kept)

    def rows(self) -> Iterator:
        """ROUGH: the best subjects, then a row without ref_id for each query."""
        import pyarrow as pa

        if self.refs:
            self.score()
        n = [len(x[0]) for x in self.kept]
        which = pa.array(np.repeat(np.arange(len(n)), n))
        refs, scores, loose = (np.concatenate([x[c] for x in self.kept] or [[]]).astype(np.int32) for c in range(3))
        none, tight = pa.nulls(len(self.numbers), pa.int32()), pa.array(np.zeros(len(self.numbers), np.int32))
        names = [x.split()[0] for x in ROUGH.split(", ")]
        zero = pa.array(np.zeros(sum(n), np.int64))
        files, numbers = pa.array(self.files, pa.string()), pa.array(self.numbers, pa.int64())
        yield pa.RecordBatch.from_arrays([files.take(which), numbers.take(which), pa.array(refs), pa.array(scores), zero, zero, pa.array(loose)], names)
        yield pa.RecordBatch.from_arrays([files, numbers, none, none, pa.array([self.residues * len(c) for c in self.codes], pa.int64()), pa.array(self.overflows), tight], names)


def scored(db: DataFrame, queries: list[tuple[str | None, int, bytes]], config: SearchConfig) -> DataFrame:
    """ROUGH candidates of few queries, told to all tasks; the database is read where it lies."""
    shared = db.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator) -> Iterator:
        tally = Tally(shared.value, config)
        for batch in batches:
            for ref, codes in zip(batch.column("ref_id").to_pylist(), batch.column("residues").to_pylist(), strict=True):
                tally.add(ref, codes)
        yield from tally.rows()

    return db.select("ref_id", "residues").mapInArrow(run, ROUGH)


def scored_in_cells(db: DataFrame, queries: DataFrame, blocks: int, slices: int, config: SearchConfig) -> DataFrame:
    """ROUGH candidates of any number of queries: each block of queries meets each slice of the database in a cell of its own.

    Blocks and slices are drawn by hash. In a cell the queries come first, then its subjects pass by one after another.
    What is shuffled, the database once a block and the queries once a slice, is little next to the scoring: a cell's
    cells of the recurrence are the product of what it reads.
    """
    drawn = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(drawn(blocks, "file", "query_num").alias("block"), every(slices).alias("slice"), F.lit(0).alias("part"), "file", "query_num", F.encode("sequence", "utf-8").alias("data"))
    read = db.select(every(blocks).alias("block"), drawn(slices, "ref_id").alias("slice"), F.lit(1).alias("part"), F.lit(None).cast("string").alias("file"), F.col("ref_id").cast("long").alias("query_num"), F.col("residues").alias("data"))
    dealt = asked.unionByName(read).repartition(min(blocks * slices, MOST_TASKS), "block", "slice").sortWithinPartitions("block", "slice", "part")

    def run(batches: Iterator) -> Iterator:
        cell, asked, tally = None, [], None
        for batch in batches:
            for block, slice_, part, file, number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, slice_) != cell:
                    if tally:
                        yield from tally.rows()
                    cell, asked, tally = (block, slice_), [], None
                if part == 0:
                    asked.append((file, number, data))
                elif asked:
                    tally = tally or Tally(asked, config)
                    tally.add(number, data)
        if tally:
            yield from tally.rows()

    return dealt.mapInArrow(run, ROUGH)


def settled(rough: DataFrame, queries: DataFrame, db: DataFrame, config: SearchConfig) -> DataFrame:
    """CANDIDATES of ROUGH ones: bounds that reach the surely best of all tasks are replaced by scores, the others left out."""
    own = ["file", "query_num"]
    ranked = Window.partitionBy(own).orderBy(F.desc("sure")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edged = rough.withColumn("sure", F.col("score") - F.col("slack")).withColumn("edge", F.nth_value("sure", max(1, config.top)).over(ranked))
    # Rows that are settled go to no subject, and to many tasks.
    elsewhere = -1 - F.pmod(F.xxhash64("query_num", "ref_id", "cells"), F.lit(1 << 20)).cast("int")
    left = edged.where("ref_id is null or edge is null or score >= edge").withColumn("open", F.when(F.col("slack") > 0, F.col("ref_id")).otherwise(elsewhere))
    asked = queries.select(F.coalesce("file", F.lit("")).alias("__file"), F.col("query_num").alias("__num"), F.col("sequence").alias("query"))
    texts = db.select(F.col("ref_id").alias("__ref"), "residues")
    paired = left.join(texts, F.col("open") == F.col("__ref"), "left")
    paired = paired.join(asked, (F.col("slack") > 0) & (F.coalesce("file", F.lit("")) == F.col("__file")) & (F.col("query_num") == F.col("__num")), "left")
    names = [x.split()[0] for x in CANDIDATES.split(", ")]
    # Scoring takes seconds of a core for some MB: dealt evenly, whatever the size.
    dealt = paired.select(*names, "slack", "query", "residues").repartition(4 * db.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = residues.matrix(config.matrix)
        for batch in batches:
            scores, loose = batch.column("score").to_pylist(), [i for i, x in enumerate(batch.column("slack").to_pylist()) if x]
            asked, texts = batch.column("query").take(pa.array(loose, pa.int64())).to_pylist(), batch.column("residues").take(pa.array(loose, pa.int64())).to_pylist()
            for i, n in zip(loose, pair_scores([(residues.encode(q), s or b"") for q, s in zip(asked, texts, strict=True)], table, *config.gaps).tolist(), strict=True):
                scores[i] = n
            columns = [pa.array(scores, pa.int32()) if c == "score" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return dealt.mapInArrow(run, CANDIDATES)


def spread(db: DataFrame) -> DataFrame:
    """A database too small to fill all tasks is dealt anew; a large one is read as it lies, without a shuffle."""
    tasks = 2 * db.sparkSession.sparkContext.defaultParallelism
    r = db.agg(F.sum("length").alias("n"), F.count("*").alias("rows")).first()
    return db.select("ref_id", "residues").repartition(max(1, min(tasks, r["rows"]))) if (r["n"] or 0) < tasks * SMALL_TASK else db


#: Steps that a database which is read as it lies does not have.
MADE = re.compile(r"^\W*(Join|Window|Aggregate|Repartition|RebalancePartitions|MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython|Sort|Generate|FlatMapGroups|Expand|Distinct)", re.M)


def kept(db: DataFrame) -> DataFrame:
    """A database (or queries) that is worked out (parsed, numbered, encoded, joined) is written once, as a search reads it
    several times; one that is a table, or persisted, is taken as it lies."""
    level = db.storageLevel
    if level.useMemory or level.useDisk or not MADE.search(db._jdf.queryExecution().optimizedPlan().toString()):
        return db
    path = f"{shared_folder(db.sparkSession)}/{uuid.uuid4()}"
    db.write.parquet(path)
    return db.sparkSession.read.schema(db.schema).parquet(path)


def identity(queries: DataFrame) -> list[str]:
    """The columns that tell queries apart: their number, and their file if they have one."""
    return ["file", "query_num"] if "file" in queries.columns else ["query_num"]


@dataclass
class Result:
    """Hits and statistics of a search. Both come from `candidates`; persist that to use both.

    Where queries have a `file`, so have hits and statistics, and numbers may be the same in several files.
    """

    queries: DataFrame
    db: DataFrame
    config: SearchConfig
    candidates: DataFrame
    seconds: float | None = None

    def top_scores(self) -> DataFrame:
        """([file,] query_num, result_num, score, ref_id)."""
        own = identity(self.queries)
        order = Window.partitionBy(own).orderBy(F.desc("score"), "ref_id")
        ranked = self.candidates.where("ref_id is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= self.config.top)
        return ranked.select(*own, (F.col("n") - 1).cast("int").alias("result_num"), "score", "ref_id")

    def hits(self) -> DataFrame:
        """Hits with what the database and the queries tell; headers are looked up for hits only."""
        named = self.db.select("ref_id", F.col("length").alias("reference_length"), F.col("header").alias("reference_header"))
        own = identity(self.queries)
        asked = self.queries.select(*own, F.octet_length("sequence").cast("int").alias("query_length"), F.col("header").alias("query_header"))
        return self.top_scores().join(named, "ref_id").join(asked, own).select(*own[:-1], *HITS)

    def stats(self) -> DataFrame:
        """([file,] query_num, num_overflows, cells) of each query."""
        return self.candidates.where("ref_id is null").groupBy(identity(self.queries)).agg(F.sum("overflows").cast("long").alias("num_overflows"), F.sum("cells").cast("long").alias("cells"))

    def metrics(self) -> DataFrame:
        """One row: cells, overflows, seconds and billions of cells a second of the whole run; `timed` measures it."""
        return self.stats().agg(F.sum("cells").alias("cells"), F.sum("num_overflows").alias("num_overflows")).select("*", F.lit(self.seconds).alias("seconds"), (F.col("cells") / 1e9 / F.lit(self.seconds)).alias("gcups"))

    def timed(self) -> Result:
        """With the candidates computed and kept, and the time that took."""
        began = time.perf_counter()
        self.candidates = self.candidates.persist()
        self.candidates.count()
        self.seconds = time.perf_counter() - began
        return self


def search(queries: DataFrame, db: DataFrame, config: SearchConfig = SearchConfig()) -> Result:
    """`queries` ([file,] query_num, header, sequence) against `db` (ref_id, length, header, residues).

    Queries are told apart by their number, or by file and number where they have a `file`; others of the same are refused.
    What is not at rest is written once (`kept`). Up to QUERY_BYTES of queries are told to all tasks, which read the database where it lies; more are dealt with it in
    cells (`scored_in_cells`). Only best candidates leave a task: of queries of usual length those whose bound may be among the
    best, which are scored when all tasks' bounds are known (`settled`). Null sequences are empty and score 0.
    """
    queries = kept(queries)
    if "file" in queries.columns:
        queries = queries.withColumn("file", F.coalesce("file", F.lit("")))
    file = F.col("file") if "file" in queries.columns else F.lit(None).cast("string").alias("file")
    asked = queries.select(file, "query_num", F.coalesce("sequence", F.lit("")).alias("sequence"))
    size = F.octet_length("sequence")
    if twice := asked.groupBy("file", "query_num").count().where("count > 1").first():
        raise ValueError(f"several queries are number {twice['query_num']}" + (f" of {twice['file']}" if twice["file"] else "; queries of several files need a column `file`"))
    db = kept(db)
    told = asked.agg(F.sum(size + 64).alias("all"), F.max(size).alias("longest"), F.max_by("query_num", size).alias("which")).first()
    if (told["longest"] or 0) > LIMIT:
        raise ValueError(f"query {told['which']} is too long")
    if (told["all"] or 0) <= QUERY_BYTES:
        few = sorted(((r["file"], r["query_num"], r["sequence"].encode()) for r in asked.collect()), key=lambda q: (q[0] or "", q[1]))
        rough = scored(spread(db), few, config)
        loose = config.top and any(bounded(config, len(q)) for _, _, q in few)
        return Result(queries, db, config, settled(rough, asked, db, config) if loose else rough.drop("slack"))
    n = db.agg(F.sum("length")).first()[0] or 0
    blocks, slices = -(-told["all"] // QUERY_BLOCK), -(-n // SLICE) or 1
    rough = scored_in_cells(db, asked, blocks, slices, config)
    candidates = settled(rough, asked, db, config) if config.top else rough.drop("slack")
    # A query without any subject in sight still has a row of its own.
    candidates = candidates.unionByName(asked.select("file", "query_num", *[F.lit(v).cast(t).alias(c) for c, t, v in (("ref_id", "int", None), ("score", "int", None), ("cells", "long", 0), ("overflows", "long", 0))]))
    return Result(queries, db, config, candidates)


def all_pairs(queries: DataFrame, db: DataFrame, config: SearchConfig = SearchConfig(), most: int = 10_000_000) -> DataFrame:
    """Every score, for checking small inputs: (query_num, ref_id, score). More than `most` pairs are refused."""
    from seqscan.functions.registry import aa_decode, sw_score

    if (n := queries.count() * db.count()) > most:
        raise ValueError(f"{n} pairs; all_pairs is for {most} at most")
    crossed = queries.select("query_num", F.col("sequence").alias("q")).crossJoin(db.select("ref_id", aa_decode("residues").alias("s")))
    return crossed.select("query_num", "ref_id", sw_score(F.col("q"), F.col("s"), config.matrix, *config.gaps).alias("score"))
