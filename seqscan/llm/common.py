"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqscan.sources.folders import shared_folder

#: Whitespace between words and a character of a word, as regular expressions for Spark.
GAP, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body` as often as wanted.

    Catalyst would else paste the expression wherever a lambda mentions it and evaluate it again for each element.
    """
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For each whole number of an array the combination (sum, maximum) of those before it, 0 for the first.

    Blocks are combined first, so the work is linear for arrays of any sensible length, and no array grows item by item.
    """
    zero = F.lit(0)
    part = lambda v, start, n: F.aggregate(F.slice(v, start, n), zero, combine)

    def of(v: Column) -> Column:
        blocks = F.sequence(zero, F.floor((F.size(v) - 1) / block).cast("int"))
        totals = F.transform(blocks, lambda b: part(v, b * block + 1, F.lit(block)))
        within = lambda ahead: F.transform(v, lambda _, k: combine(ahead[F.floor(k / block).cast("int")], part(v, k - k % block + 1, k % block)))
        return let(totals, lambda t: let(F.transform(blocks, lambda b: part(t, F.lit(1), b)), within))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def words_of(text: Column) -> Column:
    """The words of a text; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def small_or_not(df: DataFrame, most: int) -> DataFrame:
    """`df` marked for broadcasting if it has `most` rows or fewer, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def slices(batches: Iterator, size_column: str, most_bytes: int) -> Iterator:
    """Arrow batches cut so that a slice holds about `most_bytes` of the given binary column, one row at least."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(size_column)
        import pyarrow.compute as pc

        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
            yield batch.slice(at, upto - at)
            at = upto
