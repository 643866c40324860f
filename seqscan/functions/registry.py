"""Column functions over sequences, also by name from SQL once `register` has run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import PandasUDFType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn

from . import residues
from .scoring import pair_scores


@F.pandas_udf(T.BinaryType())
def aa_encode(sequences: pd.Series) -> pd.Series:
    """Residue codes of sequences; null stays null."""
    return sequences.map(lambda s: None if s is None else residues.encode(s))


@F.pandas_udf(T.StringType())
def aa_decode(codes: pd.Series) -> pd.Series:
    """Letters of residue codes; null stays null."""
    return codes.map(lambda c: None if c is None else residues.decode(c))


def code_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each residue code stands in a column of sequences: a row n0 ... n20 for each batch, to be summed.

    A null sequence counts as an empty one; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = batch.column(0).cast(pa.large_binary())
            if not len(sequences):
                continue
            bounds = np.frombuffer(sequences.buffers()[1], np.int64)[sequences.offset : sequences.offset + len(sequences) + 1]
            held = sequences.buffers()[2]
            letters = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.empty(0, np.uint8)
            n = np.bincount(np.frombuffer(residues.CODES, np.uint8), np.bincount(letters, minlength=256), 21).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in n], [f"n{i}" for i in range(21)])

    return df.select(F.col(column).cast("binary")).mapInArrow(count, ", ".join(f"n{i} long" for i in range(21)))


def self_score(sequence: Column | str, matrix: str = "blosum62") -> Column:
    """Score of a sequence aligned with itself without gaps: the diagonal summed over its residues; null if it is null."""
    diagonal = residues.matrix(matrix).diagonal().astype(np.int64)

    @F.pandas_udf(T.LongType())
    def score(sequences: pd.Series) -> pd.Series:
        one = lambda s: None if s is None else int(np.bincount(np.frombuffer(residues.encode(s), np.uint8), minlength=21) @ diagonal)
        return pd.Series([one(s) for s in sequences], dtype="Int64")

    return score(sequence)


def sw_score(query: Column, subject: Column, matrix: str = "blosum62", gop: int | None = None, gex: int | None = None) -> Column:
    """Optimal local alignment score of each row's pair of sequences (strings); null if either is null."""
    default = residues.GAPS[matrix.removesuffix("_20")] if matrix.removesuffix("_20") in residues.GAPS else (0, 0)
    table, gaps = residues.matrix(matrix), (default[0] if gop is None else gop, default[1] if gex is None else gex)

    @F.pandas_udf(T.IntegerType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, subjects in batches:
            whole = queries.notna() & subjects.notna()
            out = pd.Series([None] * len(queries), dtype="Int32")
            pairs = [(residues.encode(q), residues.encode(s)) for q, s in zip(queries[whole], subjects[whole], strict=True)]
            out[whole.to_numpy()] = pair_scores(pairs, table, *gaps)
            yield out

    return score(query, subject)


def scoring_of(matrix: str | None, gop: int | None, gex: int | None) -> tuple:
    """Substitution matrix and gap scores, the default or the matrix's own where null."""
    name = matrix or "blosum62"
    own = residues.GAPS.get(name.removesuffix("_20"), (0, 0))
    return residues.matrix(name), own[0] if gop is None else int(gop), own[1] if gex is None else int(gex)


@F.udtf(returnType="ref_id int, score int")
class AlignTopK:
    """`align_topk(TABLE(db), query, top[, matrix, gop, gex])`: the best subjects of each part of the table that a task reads.

    A table function's tasks don't know of each other; `align_best` makes the whole table's of theirs.
    """

    def __init__(self):
        self.waiting: list[tuple[int, bytes]] = []
        self.kept: list[tuple[int, int]] = []
        self.asked: tuple = ("", 0, None, None, None)

    def eval(self, row, query: str, top: int, matrix: str = "blosum62", gop: int = None, gex: int = None):
        self.asked = (query or "", top, matrix, gop, gex)
        self.waiting.append((row["ref_id"], bytes(row["residues"] or b"")))
        if len(self.waiting) >= 5_000:
            self.score()

    def score(self):
        query, top, *rule = self.asked
        codes = residues.encode(query)
        found = pair_scores([(codes, s) for _, s in self.waiting], *scoring_of(*rule))
        self.kept += [(ref, int(n)) for (ref, _), n in zip(self.waiting, found, strict=True)]
        self.kept = sorted(self.kept, key=lambda x: (-x[1], x[0]))[:top]
        self.waiting = []

    def terminate(self):
        self.score()
        yield from self.kept


@F.udtf
class AlignBest:
    """`align_best(TABLE(SELECT * FROM align_topk(...)), top)`: (ref_id, score, result_num) of the best subjects of the whole
    table, as a search has them, from those of each task. What comes together in one task is `top` rows for each of them,
    in order, and one is held at a time."""

    @staticmethod
    def analyze(table: AnalyzeArgument, top: AnalyzeArgument) -> AnalyzeResult:
        fields = [T.StructField("ref_id", T.IntegerType()), T.StructField("score", T.IntegerType()), T.StructField("result_num", T.IntegerType())]
        return AnalyzeResult(T.StructType(fields), withSinglePartition=True, orderBy=[OrderingColumn("score", ascending=False), OrderingColumn("ref_id")])

    def __init__(self):
        self.given = 0

    def eval(self, row, top: int):
        if self.given < top:
            yield row["ref_id"], row["score"], self.given
            self.given += 1


def register(spark: SparkSession) -> None:
    """For SQL: aa_encode, aa_decode, length_partition, sw_score(query, subject[, matrix, gop, gex]), align_topk, align_best.

    sw_score of a null sequence is null, as the column function has it.
    """
    spark.udtf.register("align_topk", AlignTopK)
    spark.udtf.register("align_best", AlignBest)
    spark.udf.register("aa_encode", aa_encode)
    spark.udf.register("aa_decode", aa_decode)
    bounds = residues.BOUNDS

    @F.pandas_udf(T.IntegerType())
    def bucket(lengths: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(np.where(lengths.isna(), -1, np.searchsorted(bounds, lengths.fillna(0)))).astype("Int32").replace(-1, pd.NA)

    def score(*given: pd.Series) -> pd.Series:
        rules = list(zip(*given[2:], strict=True)) or [()] * len(given[0])
        texts = list(zip(given[0], given[1], strict=True))
        out = pd.Series([None] * len(texts), dtype="Int32")
        asked: dict[tuple, list[int]] = {}
        for i, rule in enumerate(rules):
            if texts[i][0] is None or texts[i][1] is None:
                continue
            asked.setdefault(tuple(None if pd.isna(x) else x for x in (*rule, None, None, None)[:3]), []).append(i)
        for rule, places in asked.items():
            out.iloc[places] = pair_scores([(residues.encode(texts[i][0]), residues.encode(texts[i][1])) for i in places], *scoring_of(*rule))
        return out

    spark.udf.register("length_partition", bucket)
    spark.udf.register("sw_score", F.pandas_udf(score, T.IntegerType(), PandasUDFType.SCALAR))
