"""Scores against a plain dynamic program, worked examples and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqscan.functions import residues, scoring
from seqscan.functions.registry import register, sw_score

GAPS = [(-11, -1), (-13, -2), (-10, -1), (-5, -5), (-2, -1), (-1, -3)]
TWO = (
    "MGFTEKQEALVNSSSQLFKQNPSNYSVLFYTIILQKAPTAKAMFSFLKDSAGVVDSPKLGAHAEKVFGMVRDSAVQLRATGEVVLDGKDGSIHIQKGVLDPHFVVVKEALLKTIKEASGDKWSEELSAAWEVAYDGLATAIKAA",
    "MALPFALLMALVVLSCKSSCSLDCDLPQTHSLGHRRTMMLLAQMRRISLFSCLKDRHDFRFPQEEFDGNQFQKAEAISVLHEVIQQTFNLFSTKDSSVAWDERLLDKLYTELYQQLNDLEACVMQEVWVGGTPLMNEDSILAVRKYFQRITLYLTEKKYSPCAWEVVRAEIMRSFSSSRNLQERLRRKE",
)


def plain(q, s, table, gop, gex):
    m, n = len(q), len(s)
    h = [[0] * (n + 1) for _ in range(m + 1)]
    e = [[-10000] * (n + 1) for _ in range(m + 1)]
    f = [[-10000] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            e[i][j] = max(e[i][j - 1] + gex, h[i][j - 1] + gop)
            f[i][j] = max(f[i - 1][j] + gex, h[i - 1][j] + gop)
            h[i][j] = max(0, h[i - 1][j - 1] + int(table[q[i - 1]][s[j - 1]]), e[i][j], f[i][j])
    return max(map(max, h))


def one(q, s, name="blosum62", gaps=None):
    return int(scoring.pair_scores([(residues.encode(q), residues.encode(s))], residues.matrix(name), *(gaps or residues.GAPS[name]))[0])


@pytest.mark.parametrize(("q", "s", "score"), [("W", "W", 11), ("A", "W", 0), (residues.ALPHABET, residues.ALPHABET, 116), ("arndc", "ARNDC", 0), ("XXXX", "XXXX", 0), ("W" * 8, "WWWWAWWWW", 77), ("W" * 8, "WWWWAAWWWW", 76), ("WWWWAAWWWW", "W" * 8, 76), ("HEAGAWGHEE", "PAWHEAE", 17), ("MKV", "MKXV", 10), ("", "A", 0), ("A", "", 0)])
def test_worked_examples(q, s, score):
    assert one(q, s) == score


@pytest.mark.parametrize(("name", "gaps", "scores"), [("blosum62", (-11, -1), (719, 26, 977)), ("blosum80", (-10, -1), (780, 26, 1065)), ("blosum50", (-13, -2), (910, 37, 1258)), ("blosum45", (-13, -2), (849, 32, 1182)), ("blosum45", (-11, -1), (849, 41, 1182))])
def test_real_proteins(name, gaps, scores):
    a, b = TWO
    assert (one(a, a, name, gaps), one(a, b, name, gaps), one(b, b, name, gaps)) == scores
    assert one(b, a, name, gaps) == scores[1]


codes = st.lists(st.sampled_from([0, 0, 17, 17, 1, 4, 10, 20]), max_size=40).map(bytes)


@settings(max_examples=60, deadline=None)
@given(codes, st.lists(codes, min_size=1, max_size=12), st.sampled_from(GAPS), st.sampled_from(sorted(residues.GAPS)))
def test_equals_plain_program(q, subjects, gaps, name):
    table = residues.matrix(name)
    got = scoring.all_scores([q], subjects, table, *gaps)[0].tolist()
    assert got == [plain(q, s, table, *gaps) for s in subjects]
    padded = scoring.all_scores([q + bytes([20] * 5)], [s + bytes([20] * 7) for s in subjects], table, *gaps)[0].tolist()
    assert padded == got
    assert scoring.all_scores(subjects, [q], table, *gaps)[:, 0].tolist() == got


def test_long_scores_leave_16_bits():
    w = bytes([17]) * 4000
    assert scoring.all_scores([w], [w, w[:10]], residues.matrix("blosum62"), -11, -1)[0].tolist() == [44000, 110]


@settings(max_examples=40, deadline=None)
@given(codes, st.lists(codes, min_size=1, max_size=6), st.sampled_from(GAPS), st.integers(1, 9))
def test_tiles_equal_whole_subjects(q, subjects, gaps, tile):
    table = residues.matrix("blosum62")
    whole = scoring.all_scores([q, q[:5]], subjects, table, *gaps).tolist()
    kept, scoring.TILE = scoring.TILE, tile
    try:
        assert scoring.all_scores([q, q[:5]], subjects, table, *gaps).tolist() == whole
    finally:
        scoring.TILE = kept


def test_fifty_million_residues_in_bounded_memory():
    import tracemalloc

    subject = bytearray(np.tile(np.frombuffer(residues.encode("ARNDCQEGHILKMFPSTYV"), np.uint8), 50_000_000 // 19 + 1).tobytes()[:50_000_000])
    query = residues.encode("WWWWHEAGAWGHEEWWWW")
    border = 190 * scoring.TILE
    subject[border - 9 : border + 9] = query
    tracemalloc.start()
    try:
        got = scoring.all_scores([query], [bytes(subject)], residues.matrix("blosum62"), -11, -1)
        assert tracemalloc.get_traced_memory()[1] < 400 << 20
    finally:
        tracemalloc.stop()
    assert got.tolist() == [[one("WWWWHEAGAWGHEEWWWW", "WWWWHEAGAWGHEEWWWW")]]


def test_blocks_hold_every_row_once():
    lengths = np.array([0, 5, 9000, 1, 300, 301, 5, 20000, 16] * 700)
    groups = scoring.grouped(lengths)
    assert sorted(np.concatenate(groups).tolist()) == list(range(len(lengths)))


def test_codes_and_buckets():
    assert residues.encode("ARNDVarBZ*\r") == bytes([0, 1, 2, 3, 19, 20, 20, 20, 20, 20, 20])
    assert residues.decode(bytes([0, 19, 20, 25])) == "AV--"
    for name in residues.GAPS:
        m = residues.matrix(name)
        assert (m == m.T).all() and (m[20] == residues.LOW[name]).all() and (residues.matrix(name + "_20") == m).all()
    with pytest.raises(ValueError, match="unknown matrix"):
        residues.matrix("blosum90")


def test_functions_from_sql(spark):
    register(spark)
    spark.createDataFrame([("WW", "WWA"), (None, "A"), ("", "A")], "q string, s string").createOrReplaceTempView("some")
    rows = spark.sql("SELECT sw_score(q, s) AS n, aa_decode(aa_encode(s)) AS d, length_partition(octet_length(s)) AS p FROM some").collect()
    assert [(r.n, r.d, r.p) for r in rows] == [(22, "WWA", 0), (None, "A", 0), (0, "A", 0)]
    some = spark.table("some")
    assert [r[0] for r in some.select(sw_score(some.q, some.s)).collect()] == [22, None, 0]
    edges = spark.createDataFrame([(x + d,) for x in residues.BOUNDS[:-1] for d in (0, 1)] + [(0,)], "n int")
    for r in edges.select("n", residues.length_partition(edges.n).alias("p"), residues.padded_length(edges.n).alias("four")).collect():
        assert r.p == int(np.searchsorted(residues.BOUNDS, r.n)) and r.four == -(-r.n // 4) * 4
