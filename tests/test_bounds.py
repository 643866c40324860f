"""Bounds that come before scores in a search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqscan.functions import residues, scoring
from seqscan.operators import search as searching
from seqscan.operators.search import Tally, search
from seqscan.plans.config import SearchConfig


def drawn(draw: random.Random, n: int) -> bytes:
    return bytes(draw.randrange(21) for _ in range(n))


def letters(codes: bytes) -> str:
    return residues.decode(codes).replace("-", "X")


@pytest.mark.parametrize("matrix", sorted(residues.GAPS))
@pytest.mark.parametrize("gaps", [None, (-5, -2), (-4, -4), (-20, -3)])
def test_bounds_hold(matrix, gaps):
    draw = random.Random(5)
    table, (gop, gex) = residues.matrix(matrix), gaps or residues.GAPS[matrix]
    assert scoring.bounds_fit(table, gop, gex)
    queries = [drawn(draw, n) for n in (1, 2, 7, 30, 64, 90)]
    subjects = [drawn(draw, n) for n in (0, 1, 2, 3, 20, *(draw.randrange(1, 300) for _ in range(40)))]
    subjects += [drawn(draw, 50) + q[: len(q) // 2] + drawn(draw, draw.randrange(4)) + q[len(q) // 2 :] for q in queries]
    bounds, scores = (f(queries, subjects, table, gop, gex) for f in (scoring.upper_bounds, scoring.all_scores))
    told = bounds != scoring.BEYOND
    assert (bounds >= scores).all() and not told.all()
    assert (bounds - scoring.slack(bounds, gop, gex) <= scores)[told].all()
    assert (scores[~told] > 100).all()


def test_bounds_of_long_subjects_in_pieces():
    """Alignments that a border between pieces would cut, one of them with a long gap."""
    draw = random.Random(6)
    table = residues.matrix("blosum62")
    query = drawn(draw, 30)
    overlap = scoring.span(np.frombuffer(query, np.uint8), table, -11, -1)
    whole = max(8 * overlap, 1 << 13)
    at = [whole - overlap - 15, whole - 15, 2 * (whole - overlap) - 1]
    subjects = []
    for a in at:
        for gap in (0, 60):
            text = bytearray(bytes([20]) * 30_000)
            text[a : a + 30 + gap] = query[:15] + bytes([20]) * gap + query[15:]
            subjects.append(bytes(text))
    bounds, scores = (f([query], subjects, table, -11, -1) for f in (scoring.upper_bounds, scoring.all_scores))
    assert (bounds >= scores).all() and (bounds - scoring.slack(bounds, -11, -1) <= scores).all()


def test_few_subjects_are_scored(monkeypatch):
    """Passages of usual length against texts: the same best ones, scoring some hundredths of the cells."""
    draw = random.Random(7)
    syllables = [letters(drawn(draw, draw.choice((2, 3)))) for _ in range(40)]
    text = lambda n: "".join(draw.choice(syllables) for _ in range(n))
    queries = [(None, k, text(60).encode()) for k in range(3)]
    subjects = [residues.encode(text(draw.randrange(20, 300))) for _ in range(1500)]
    subjects[700] += residues.encode(queries[1][2])
    done, scored = [0], scoring.block_scores
    monkeypatch.setattr(scoring, "block_scores", lambda q, block, *a: done.__setitem__(0, done[0] + len(q) * block.subjects.size) or scored(q, block, *a))
    tally = Tally(queries, SearchConfig(top=3))
    for ref, codes in enumerate(subjects):
        tally.add(ref, codes)
    rows = [r for batch in tally.rows() for r in batch.to_pylist() if r["ref_id"] is not None]
    assert done[0] < 0.05 * sum(len(q) for _, _, q in queries) * sum(map(len, subjects))
    table = residues.matrix("blosum62")
    for _, k, q in queries:
        exact = scoring.all_scores([residues.encode(q)], subjects, table, -11, -1)[0]
        best = searching.best(np.arange(len(exact)), exact, 3).tolist()
        held = {r["ref_id"]: r["score"] for r in rows if r["query_num"] == k}
        assert set(best) <= set(held) and all(exact[ref] <= n for ref, n in held.items()) and len(held) < 150


@pytest.mark.parametrize("limits", [(64, 1 << 20), (64, 0), (0, 1 << 20)])
def test_search_by_bounds(spark, monkeypatch, limits):
    """Copies, ties, short and long queries: the rows that scoring every pair gives, told to all tasks and in cells."""
    monkeypatch.setattr(searching, "UNSETTLED", limits[0])
    monkeypatch.setattr(searching, "QUERY_BYTES", limits[1])
    draw = random.Random(8)
    texts = [letters(drawn(draw, draw.randrange(150))) for _ in range(60)]
    queries = [letters(drawn(draw, n)) for n in (70, 80, 90, 12)]
    texts += [queries[0] + "W"] * 14 + [t + queries[1][:40] for t in texts[:20]] + [queries[2][5:60]] * 3 + ["", "A"]
    draw.shuffle(texts)
    db = spark.createDataFrame([(i, len(t), str(i), bytearray(residues.encode(t))) for i, t in enumerate(texts)], "ref_id int, length int, header string, residues binary")
    asked = spark.createDataFrame([(k, str(k), q) for k, q in enumerate(queries)], "query_num long, header string, sequence string")
    for top in (1, 10, 200):
        hits = search(asked, db, SearchConfig(top=top)).hits().select("query_num", "result_num", "score", "ref_id")
        got = sorted(map(tuple, hits.collect()))
        exact = scoring.all_scores([residues.encode(q) for q in queries], [residues.encode(t) for t in texts], residues.matrix("blosum62"), -11, -1)
        refs = np.arange(len(texts))
        want = [(k, n, int(exact[k, ref]), int(ref)) for k in range(len(queries)) for n, ref in enumerate(searching.best(refs, exact[k], top))]
        assert got == want


def test_overflows_beside_bounds(spark):
    """Overflows are counted by scores, copies and all, not by bounds."""
    one = residues.decode(bytes(random.Random(9).randrange(20) for _ in range(500)))
    score = int(scoring.all_scores([residues.encode(one)], [residues.encode(one)], residues.matrix("blosum62"), -11, -1)[0, 0])
    assert score >= 2048
    db = spark.range(6).select(F.col("id").cast("int").alias("ref_id"), F.lit(500).alias("length"), F.lit("H").alias("header"), F.lit(bytearray(residues.encode(one))).alias("residues"))
    asked = spark.createDataFrame([(0, "a", one), (1, "b", one[:100])], "query_num long, header string, sequence string")
    for top in (0, 2):
        stats = {r["query_num"]: (r["num_overflows"], r["cells"]) for r in search(asked, db, SearchConfig(top=top)).stats().collect()}
        assert stats == {0: (6, 500 * 500 * 6), 1: (0, 100 * 500 * 6)}
