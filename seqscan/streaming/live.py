"""Searches that go on: a session for single questions, and a stream of query files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqscan.operators.database import ORDINALS
from seqscan.operators.search import Result, kept, search
from seqscan.sources import sinks
from seqscan.plans.config import SearchConfig
from seqscan.sources.fasta import parsed, read_sequences


@dataclass
class Answer:
    """What a dialogue says, and the lines of results it writes, if any."""

    said: list[str]
    lines: DataFrame | None = None


class Session:
    """A database kept at hand and asked again and again."""

    def __init__(self, db: DataFrame, config: SearchConfig = SearchConfig()):
        self.db, self.config = db.persist(), config
        self.spark: SparkSession = db.sparkSession

    def search(self, sequence: str) -> DataFrame:
        """Hits of one sequence given as text; its number is -1 and its header `-`."""
        asked = self.spark.createDataFrame([(-1, "-", "".join(sequence.split()))], "query_num long, header string, sequence string")
        return search(asked, self.db, self.config).hits()

    def search_file(self, path: str) -> Result:
        """Results of all records of a file."""
        return search(numbered(read_sequences(self.spark, path)), self.db, self.config)

    def command(self, line: str) -> DataFrame | str | None:
        """`s SEQUENCE`, `f FILE` or `exit` (None); anything else, and what fails, is answered with a message."""
        word, _, rest = line.strip().partition(" ")
        if word == "exit":
            return None
        try:
            if word == "s" and rest:
                return self.search(rest)
            if word == "f" and rest:
                return self.search_file(rest).hits()
        except Exception as e:
            return f"Error: {e}"
        return f"Unrecognized command: {line}"

    def close(self) -> None:
        self.db.unpersist()


class Dialogue:
    """Lines of input taken one by one: `s SEQUENCE` goes on over the next lines up to an empty one, `f FILE`, `exit`.

    Of a command's line the word after the first blank counts. Results come as tab-separated or as plain lines; of a file
    the lines about its queries are said, not written. Tab-separated results of a dialogue have the query number -1 and
    the header `-`, whatever they come from.
    """

    def __init__(self, session: Session, tsv: bool = True):
        self.session, self.tsv = session, tsv
        self.sequence: list[str] | None = None
        self.over = False

    def take(self, line: str) -> Answer | None:
        """The answer to what a line ends, or None if there is nothing to answer (yet)."""
        line = line.rstrip("\r\n")
        if self.sequence is not None:
            if line:
                self.sequence.append(line)
                return None
            return self.end()
        command, _, rest = line.partition(" ")
        word = rest.split(" ")[0]
        if command == "exit":
            self.over = True
        elif command in ("s", "f") and not word:
            return Answer([f"Missing argument for command '{command}'"])
        elif command == "s":
            self.sequence = [word]
        elif command == "f":
            return self.answered(lambda: self.of_file(word))
        elif line:
            return Answer([f"Unrecognized command: {command}"])
        return None

    def end(self) -> Answer | None:
        """The answer to a sequence that is still open, as at the end of the input."""
        if self.sequence is None:
            return None
        sequence, self.sequence = "".join(self.sequence), None
        return self.answered(lambda: Answer([f"sequence: {sequence}"], self.written(self.session.search(sequence))))

    def written(self, hits: DataFrame) -> DataFrame:
        """Lines of results, in order of the queries of a file."""
        if not self.tsv:
            return sinks.result_lines(hits)
        return sinks.tsv_lines(hits, anonymous=True)

    def of_file(self, path: str) -> Answer:
        found = self.session.search_file(path)
        said = sinks.in_order(sinks.query_lines(found.queries, found.stats()))
        return Answer([r["line"] for r in said.toLocalIterator()], self.written(found.hits()))

    def answered(self, make: Callable[[], Answer]) -> Answer:
        try:
            return make()
        except Exception as e:
            return Answer([f"Error: {e}"])


def numbered(records: DataFrame) -> DataFrame:
    """Records as queries; numbers begin at 0 in each file. `file` stays, to tell the files apart.

    Numbers within a block of positions are added to the count of what comes before it, so that no task has all of a file.
    """
    blocked = records.select("file", "ordinal", "header", "sequence", F.expr(f"ordinal div {ORDINALS}").alias("block"))
    counts = blocked.groupBy("file", "block").agg(F.count("*").alias("n"))
    ahead = counts.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("ordinal"))
    placed = blocked.withColumn("at", within).join(ahead, ["file", "block"])
    return placed.select("file", (F.col("ahead") + F.col("at") - 1).cast("long").alias("query_num"), "header", "sequence")


def several_files(records: DataFrame) -> DataFrame:
    """Queries of several files: file_query_num begins anew in each file, query_num (file, then record) is of all."""
    files = records.select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("file_idx"))
    mine = numbered(records).withColumnRenamed("query_num", "file_query_num")
    return mine.join(F.broadcast(files), "file").select((F.col("file_idx") * F.lit(1 << 40) + F.col("file_query_num")).alias("query_num"), "file_idx", "file_query_num", "header", "sequence")


def in_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch to a part of its own of a table at `path`, in place of an earlier try."""

    def keep(hits: DataFrame, number: int) -> None:
        hits.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keep


def stream_search(spark: SparkSession, folder: str, db: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, config: SearchConfig = SearchConfig(), once: bool = True) -> StreamingQuery:
    """Search each query file that comes into `folder`; `sink` gets the hits of a micro-batch, with file_query_num.

    With `once` the stream ends when it has seen all that is there. A micro-batch may come again after a failure, with the
    same number: `in_batches` is a sink that then replaces what it had written.
    """
    db = kept(db)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def each(batch: DataFrame, number: int) -> None:
        queries = several_files(parsed(batch))
        sink(search(queries, db, config).hits().join(queries.select("query_num", "file_query_num"), "query_num"), number)

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
