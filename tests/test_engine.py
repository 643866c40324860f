"""Files, databases, searches, sinks, streams and the command line."""

import gzip
import io

import pytest
from pyspark.sql import functions as F

from seqscan import cli
from seqscan.operators import database, search
from seqscan.plans.config import SearchConfig, parse_size
from seqscan.sources import fasta, records, sinks
from seqscan.streaming import live
from tests.test_scoring import TWO, plain
from seqscan.functions import registry, residues

FASTA = b">one the first\nMKV\n\nAW\n>two\n>three\twith tab\r\nAC\r\nDE\r\n"


@pytest.mark.parametrize(("content", "found"), [
    (FASTA, [(b"one the first", b"MKVAW", None), (b"two", b"", None), (b"three\twith tab", b"ACDE", None)]),
    (b"junk > h\nAC", [(b" h", b"AC", None)]),
    (b"", []),
    (b"no record at all", []),
    (b"@q\nAC\nGT\n+again\n@>\n+I\n>f\nMK\n", [(b"q", b"ACGT", b"@>+I"), (b"f", b"MK", None)]),
    (b">a\nA>C\n@b\nK\n", [(b"a", b"A>C", None), (b"b", b"K", None)]),
    (gzip.compress(b">z\nAA\n"), [(b"z", b"AA", None)]),
    (b">only", [(b"only", b"", None)]),
    (b">cr\n\rAC\r\n", [(b"cr", b"\rAC", None)]),
])
def test_records(content, found):
    assert list(records.parse(content)) == found


def test_bad_quality():
    bad = b">ok\nAC\n@q\nACGT\n+\nII\n"
    with pytest.raises(records.FormatError):
        list(records.parse(bad))
    assert list(records.parse(bad, permissive=True)) == [(b"ok", b"AC", None)]
    assert list(records.parse(b"@q\nAC\n+\nIIII\n", permissive=True)) == []


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "fa"
    folder.mkdir()
    (folder / "a.fasta").write_bytes(FASTA)
    (folder / "b.fa").write_bytes(gzip.compress(b">w\n" + b"W" * 60 + b"\n>x\nMKVAWW\n"))
    return folder


def test_sources_agree(spark, files):
    fasta.register(spark)
    got = fasta.read_sequences(spark, str(files)).drop("file").collect()
    also = spark.read.format("fasta").load(str(files)).drop("file").collect()
    assert sorted(map(str, got)) == sorted(map(str, also)) and len(got) == 5
    split = fasta.read_large_fasta(spark, str(files / "a.fasta")).orderBy("ordinal").collect()
    assert [(r.header, r.sequence) for r in split] == [("one the first", "MKVAW"), ("two", ""), ("three\twith tab", "ACDE")]


def test_skip_and_mates(spark, files):
    got = fasta.read_sequences(spark, str(files / "a.fasta"))
    assert [r.header for r in fasta.skip(got, 2).collect()] == ["three\twith tab"]
    assert [(r.header_1, r.header_2) for r in fasta.pairs(got).collect()] == [("one the first", "two")]
    both = fasta.pairs(got, fasta.read_sequences(spark, str(files / "b.fa"))).orderBy("pair").collect()
    assert [(r.header_1, r.header_2) for r in both] == [("one the first", "w"), ("two", "x")]


def test_database(spark, files, tmp_path):
    rows = fasta.read_sequences(spark, str(files)).withColumn("ordinal", F.col("ordinal") + F.when(F.col("file").endswith("b.fa"), 10).otherwise(0))
    database.build_db(rows, f"{tmp_path}/db")
    db = database.load_db(spark, f"{tmp_path}/db")
    got = db.orderBy("ref_id").collect()
    assert [(r.ref_id, r.length, r.length_partition, r.header) for r in got] == [(0, 0, 0, "two"), (1, 4, 0, "three\twith tab"), (2, 5, 0, "one the first"), (3, 6, 0, "x"), (4, 60, 1, "w")]
    assert database.db_info(db).first().asDict() == {"num_sequences": 5, "num_chars": 80, "min_length": 0, "max_length": 60, "avg_length": 15}
    assert {r.upper_bound: r.num_sequences for r in database.length_histogram(db).collect() if r.num_sequences} == {48: 4, 64: 1}
    assert [r.start for r in database.residue_offsets(db).orderBy("ref_id").collect()] == [0, 0, 4, 12, 20]
    assert database.lookup(db, db.where("ref_id = 3")).first().sequence == "MKVAWW"
    with pytest.raises(FileNotFoundError):
        database.load_db(spark, f"{tmp_path}/none")


def test_dense_numbers_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(database, "ORDINALS", 16)
    rows = spark.range(300).select(F.col("id").alias("ordinal"), (F.col("id") % 3).cast("int").alias("length")).repartition(7)
    got = database.with_ref_ids(rows).collect()
    assert [r.ref_id for r in sorted(got, key=lambda r: (r.length, r.ordinal))] == list(range(300))


@pytest.mark.parametrize("told", [1 << 20, 0])
def test_search_equals_plain_program(spark, monkeypatch, told):
    monkeypatch.setattr(search, "QUERY_BYTES", told)
    monkeypatch.setattr(search, "QUERY_BLOCK", 300)
    monkeypatch.setattr(search, "SLICE", 200)
    sequences = [*TWO, TWO[0][20:90], TWO[1][:50] + TWO[0][10:60], "", "W" * 30, TWO[0]]
    db = database.subjects(spark.createDataFrame([(i, f"h{i}", s) for i, s in enumerate(sequences)], "ordinal long, header string, sequence string")).repartition(3)
    queries = spark.createDataFrame([(i, f"q{i}", s) for i, s in enumerate([*sequences[:4], None])], "query_num long, header string, sequence string")
    refs = {r.ref_id: int(r.header[1:]) for r in db.collect()}
    for config in (SearchConfig(top=4), SearchConfig(top=100, matrix="blosum45", gop=-11, gex=-1), SearchConfig(top=2, gop=-1, gex=-3)):
        table = residues.matrix(config.matrix)
        want = []
        for q in range(5):
            codes = residues.encode(sequences[q] if q < 4 else "")
            all_of = sorted((-plain(codes, residues.encode(sequences[refs[r]]), table, *config.gaps), r) for r in refs)
            want += [(q, n, -s, r) for n, (s, r) in enumerate(all_of[: config.top])]
        result = search.search(queries, db, config)
        assert sorted(map(tuple, result.top_scores().collect())) == want
        residues_of = sum(len(x) for x in sequences)
        assert {r.query_num: r.cells for r in result.stats().collect()} == {q: residues_of * len(sequences[q] if q < 4 else "") for q in range(5)}
    assert search.search(queries, db, SearchConfig(top=0)).hits().collect() == []
    checked = search.all_pairs(queries.na.fill(""), db).where("query_num = 0 AND ref_id = 0").first()
    assert checked.score == 0


def test_overflows_and_metrics(spark):
    w = "W" * 400
    db = database.subjects(spark.createDataFrame([(0, "a", w), (1, "b", "W" * 240), (2, "c", "W" * 3000)], "ordinal long, header string, sequence string"))
    queries = spark.createDataFrame([(0, "q", w), (1, "short", "W")], "query_num long, header string, sequence string")
    count = lambda c: {r.query_num: r.num_overflows for r in search.search(queries, db, c).stats().collect()}
    assert count(SearchConfig()) == {0: 2, 1: 0}
    assert count(SearchConfig.dpx()) == {0: 0, 1: 0}
    assert count(SearchConfig(single_pass="float")) == {0: 1, 1: 0}
    m = search.search(queries, db).timed().metrics().first()
    assert m.cells == 401 * 3640 and m.gcups == pytest.approx(m.cells / 1e9 / m.seconds)


def test_pseudo_database_gives_equal_scores(spark):
    db = database.pseudo_db(spark, 50, 128)
    q = spark.createDataFrame([(0, "q", TWO[0])], "query_num long, header string, sequence string")
    got = search.search(q, db).top_scores().collect()
    assert [r.ref_id for r in got] == list(range(10)) and len({r.score for r in got}) == 1


def test_configuration():
    assert SearchConfig(matrix="blosum45").gaps == (-13, -2) and "gop: -11" in SearchConfig().explain()
    for bad in ({"top": -1}, {"matrix": "pam250"}, {"gop": 1}, {"many_pass_small": "float"}, {"overflow": "half2"}):
        with pytest.raises(ValueError):
            SearchConfig(**bad)
    assert [parse_size(x) for x in ("", "12", "3K", "2M", "1G")] == [0, 12, 3072, 2 << 20, 1 << 30]


def test_session_and_stream(spark, files, tmp_path):
    rows = fasta.read_sequences(spark, str(files)).withColumn("ordinal", F.monotonically_increasing_id())
    db = database.subjects(rows)
    session = live.Session(db)
    assert session.search("WWWW").first().asDict()["query_header"] == "-"
    assert session.command(f"f {files}/b.fa").count() == 10
    assert session.command("f /nowhere").startswith("Error") and session.command("hm").startswith("Unrecognized") and session.command("exit") is None
    session.close()
    seen = []
    live.stream_search(spark, str(files), db, lambda hits, n: seen.extend(hits.collect()), f"{tmp_path}/state").awaitTermination()
    assert len(seen) == 5 * 5 and {r.file_query_num for r in seen} == {0, 1, 2}


def test_sinks_and_command_line(spark, files, tmp_path, monkeypatch, capsys):
    assert cli.main(["build", str(files / "a.fasta"), f"{tmp_path}/db"], spark) == 0
    out = tmp_path / "hits.tsv"
    assert cli.main(["search", "--query", str(files / "b.fa"), "--query", str(files / "a.fasta"), "--db", f"{tmp_path}/db", "--top", "1", "--tsv", "--of", str(out)], spark) == 0
    lines = out.read_text().split("\n")
    assert lines[0].split("\t") == list(sinks.TITLES) and lines[1].split("\t")[:2] == ["0", "60"] and [x.split("\t")[0] for x in lines[1:-1]] == ["0", "1", "0", "1", "2"]
    assert cli.main(["search", "--query", str(files / "b.fa"), "--db", f"{tmp_path}/db", "--top", "2", "--of", str(out), "--verbose", "--printLengthPartitions", "--prefetchDBFile", "--dpx"], spark) == 0
    text = out.read_text()
    assert text.startswith("Query 0, headerw, length 60, num overflows 0\nResult 0. Score: 11. Length: 5. Header one the first. referenceId 2\n")
    assert cli.main(["search", "--query", "x"], spark) == 2
    monkeypatch.setattr("sys.stdin", io.StringIO("s WW\n\nbad\nexit\n"))
    assert cli.main(["search", "--interactive", "--db", f"{tmp_path}/db", "--of", str(out)], spark) == 0
    assert cli.main(["info", f"{tmp_path}/db"], spark) == 0
    assert "Unrecognized" in capsys.readouterr().out
    sinks.write_folder(sinks.tsv_lines(search.search(live.numbered(fasta.read_sequences(spark, str(files))).where("file like '%b.fa'"), database.load_db(spark, f"{tmp_path}/db")).hits()), f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").count() == 6


def test_top_of_a_table_from_sql(spark):
    registry.register(spark)
    db = database.subjects(spark.createDataFrame([(i, "h", s) for i, s in enumerate([TWO[0], TWO[1], "", "WW", TWO[0][:60]])], "ordinal long, header string, sequence string"))
    db.repartition(2).createOrReplaceTempView("db")
    got = spark.sql(f"SELECT * FROM align_topk(TABLE(SELECT ref_id, residues FROM db), '{TWO[0]}', 2) ORDER BY score DESC, ref_id LIMIT 2").collect()
    asked = spark.createDataFrame([(0, "q", TWO[0])], "query_num long, header string, sequence string")
    assert [(r.score, r.ref_id) for r in got] == [(r.score, r.ref_id) for r in search.search(asked, db, SearchConfig(top=2)).top_scores().orderBy("result_num").collect()]


def test_large_files_line_by_line(spark, tmp_path):
    import gzip

    content = b"junk\n>a one\r\nAC\n\nGT\n@q\nACGT\n+\n@>+I\n>empty\n>last\n" + b"M" * 5000
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gz").write_bytes(gzip.compress(content))
    (tmp_path / "in" / "b.fa").write_bytes(content)
    (tmp_path / "in" / "c.fa").write_bytes(gzip.compress(content))
    (tmp_path / "in" / "d.fa").write_bytes(b"")
    key = lambda r: tuple(map(str, r))
    whole = sorted(map(tuple, fasta.read_sequences(spark, f"{tmp_path}/in").collect()), key=key)
    assert len(whole) == 12
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        split = sorted(map(tuple, fasta.read_lines(spark, [f"file:{tmp_path}/in/a.gz", f"file:{tmp_path}/in/b.fa"]).collect()), key=key)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert split == [r for r in whole if r[0][-4:] in ("a.gz", "b.fa") or r[0].endswith("/a.gz")]
    some = sorted(map(tuple, fasta.read_sequences(spark, f"{tmp_path}/in", large=4000).collect()), key=key)
    assert some == whole


def test_sql_scores_by_matrix_and_gaps(spark):
    from seqscan.functions.registry import register

    register(spark)
    spark.createDataFrame([("HEAGAWGHEE", "PAWHEAE"), ("WWWWWWWW", "WWWWAWWWW"), (None, "A"), ("", "A")], "q string, s string").createOrReplaceTempView("asked")
    plain = [r[0] for r in spark.sql("SELECT sw_score(q, s) FROM asked").collect()]
    assert plain == [17, 77, None, 0]
    chosen = spark.sql("SELECT sw_score(q, s, 'blosum45', -5, -2) AS n FROM asked").collect()
    from seqscan.functions.registry import sw_score
    want = spark.table("asked").select(sw_score(spark.table("asked").q, spark.table("asked").s, "blosum45", -5, -2)).collect()
    assert [r[0] for r in chosen] == [r[0] for r in want]


def test_all_pairs_is_for_small_inputs(spark):
    from seqscan.operators import search as searching

    queries = spark.range(20).selectExpr("id AS query_num", "'x' AS header", "'WW' AS sequence")
    with pytest.raises(ValueError, match="pairs"):
        searching.all_pairs(queries, database.pseudo_db(spark, 10, 5), most=100)


def test_search_without_rows(spark, monkeypatch):
    queries = spark.createDataFrame([(7, "q", "WW")], "query_num long, header string, sequence string")
    db = database.pseudo_db(spark, 3, 5)
    for told in (1 << 20, 0):
        monkeypatch.setattr(search, "QUERY_BYTES", told)
        nothing = search.search(queries, db.where("ref_id < 0"))
        assert nothing.hits().collect() == [] and [tuple(r) for r in nothing.stats().collect()] == [(7, 0, 0)]
        assert search.search(queries.where("query_num < 0"), db).hits().collect() == []


def test_too_long_a_query_is_refused(spark, monkeypatch):
    monkeypatch.setattr(search, "LIMIT", 3)
    queries = spark.createDataFrame([(7, "q", "WW"), (8, "r", "WWWW")], "query_num long, header string, sequence string")
    with pytest.raises(ValueError, match="8"):
        search.search(queries, database.pseudo_db(spark, 3, 5))


def test_counts_and_self_scores(spark):
    rows = [("",), (None,), ("ARN",), ("arW*é",), ("V" * 300_000,)]
    df = spark.createDataFrame(rows, "sequence string").repartition(2)
    counted = registry.code_counts(df, "sequence").agg(*[F.sum(f"n{i}") for i in range(21)]).first()
    codes = [c for (s,) in rows for c in residues.encode(s or "")]
    assert list(counted) == [codes.count(i) for i in range(21)]
    assert registry.code_counts(df.where("sequence = 'none'"), "sequence").collect() == []
    table = residues.matrix("blosum80")
    got = {r.sequence: r.score for r in df.select("sequence", registry.self_score("sequence", "blosum80").alias("score")).collect()}
    assert got == {s: None if s is None else sum(int(table[c, c]) for c in residues.encode(s)) for (s,) in rows}


def test_queries_of_several_files_keep_their_own_hits(spark, tmp_path, monkeypatch):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.fa").write_text(">w\nWWWWWWWW\n>x\nMKV\n")
    (tmp_path / "q" / "b.fa").write_text(">h\nHEAGAWGHEE\n")
    db = database.subjects(spark.createDataFrame([(0, "ww", "WWWWAWWWW"), (1, "p", "PAWHEAE"), (2, "v", "VVV")], "ordinal long, header string, sequence string"))
    queries = live.numbered(fasta.read_sequences(spark, f"{tmp_path}/q"))
    for told in (1 << 20, 0):
        monkeypatch.setattr(search, "QUERY_BYTES", told)
        result = search.search(queries, db, SearchConfig(top=1))
        best = {(r.file[-4:], r.query_num): (r.query_header, r.score, r.reference_header) for r in result.hits().collect()}
        assert best == {("a.fa", 0): ("w", 77, "ww"), ("a.fa", 1): ("x", 4, "v"), ("b.fa", 0): ("h", 17, "p")}
        assert {(r.file[-4:], r.query_num): r.cells for r in result.stats().collect()} == {("a.fa", 0): 152, ("a.fa", 1): 57, ("b.fa", 0): 190}
    with pytest.raises(ValueError, match="column `file`"):
        search.search(queries.drop("file"), db)
    out = tmp_path / "hits.txt"
    database.build_db(spark.createDataFrame([(0, "ww", "WWWWAWWWW"), (1, "p", "PAWHEAE")], "ordinal long, header string, sequence string"), f"{tmp_path}/db")
    assert cli.main(["search", "--query", f"{tmp_path}/q/*.fa", "--db", f"{tmp_path}/db", "--top", "1", "--of", str(out)], spark) == 0
    assert [x.split(",")[1].strip() if x.startswith("Query") else x.split(": ")[1] for x in out.read_text().splitlines()] == ["headerw", "77. Length", "headerx", "1. Length", "headerh", "17. Length"]


def test_numbers_of_a_database_of_several_files(spark, monkeypatch):
    monkeypatch.setattr(database, "ORDINALS", 4)
    rows = [(f, i, f"{f}{i}", "A" * (i % 3)) for f in ("b", "a", "c") for i in range(20)]
    df = spark.createDataFrame(rows, "file string, ordinal long, header string, sequence string")
    want = [r[2] for r in sorted(rows, key=lambda r: (len(r[3]), r[0], r[1]))]
    for parts in (1, 5):
        assert [r.header for r in database.subjects(df.repartition(parts)).orderBy("ref_id").collect()] == want


def test_derived_databases_are_worked_out_once(spark, sf_dir):
    from seqscan.plans import catalog

    derived = catalog.document_db(spark, sf_dir)
    hits = catalog.names_in_documents(spark, sf_dir)
    assert "documents.parquet" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert not any("documents.parquet" in f for f in hits.inputFiles())
    stored = search.kept(derived)
    assert stored is not derived and search.kept(stored) is stored
    held = derived.persist()
    assert search.kept(held) is held
    held.unpersist()


def test_a_repeated_micro_batch_replaces_itself(spark, tmp_path):
    sink = live.in_batches(f"{tmp_path}/hits")
    hits = spark.range(5).selectExpr("id AS query_num")
    for number in (0, 1, 0, 1, 1):
        sink(hits, number)
    assert spark.read.parquet(f"{tmp_path}/hits").count() == 10


def test_dialogue(spark, tmp_path):
    db = database.subjects(spark.createDataFrame([(0, "ww", "WWWWAWWWW"), (1, "p", "PAWHEAE")], "ordinal long, header string, sequence string"))
    (tmp_path / "q.fa").write_text(">one\nHEAGAWGHEE\n>two\nWW\n")

    def talk(tsv, *lines):
        session = live.Session(db, SearchConfig(top=1))
        dialogue = live.Dialogue(session, tsv)
        answers = [a for a in [*map(dialogue.take, lines), dialogue.end()] if a]
        out = [(a.said, [r.line for r in sinks.in_order(a.lines).collect()] if a.lines else None) for a in answers]
        session.close()
        return out, dialogue.over

    one = "Result 0. Score: 77. Length: 9. Header ww. referenceId 1"
    assert talk(False, "s WWWW more\n", "WWWW\n", "\n", "exit\n") == ([(["sequence: WWWWWWWW"], [one])], True)
    assert talk(True, "s WWWW", "WW", "WW") == ([(["sequence: WWWWWWWW"], ["-1\t8\t-\t0\t77\t9\tww\t1"])], False)
    said = ["Query 0, headerone, length 10, num overflows 0", "Query 1, headertwo, length 2, num overflows 0"]
    assert talk(False, f"f {tmp_path}/q.fa")[0] == [(said, ["Result 0. Score: 17. Length: 7. Header p. referenceId 0", "Result 0. Score: 22. Length: 9. Header ww. referenceId 1"])]
    assert talk(True, f"f {tmp_path}/q.fa")[0][0][1] == ["-1\t10\t-\t0\t17\t7\tp\t0", "-1\t2\t-\t0\t22\t9\tww\t1"]
    got, over = talk(True, "", "s", "f ", "what now", "f /nowhere.fa")
    assert [a[0][0][:12] for a in got] == ["Missing argu", "Missing argu", "Unrecognized", "Error: [PATH"] and not over


def test_best_of_a_whole_table_from_sql(spark):
    registry.register(spark)
    sequences = [TWO[0], TWO[1], "", "WW", TWO[0][:60], TWO[0][5:]]
    db = database.subjects(spark.createDataFrame([(i, "h", s) for i, s in enumerate(sequences)], "ordinal long, header string, sequence string"))
    db.repartition(4).createOrReplaceTempView("many")
    asked = spark.createDataFrame([(0, "q", TWO[0])], "query_num long, header string, sequence string")
    for top, rule, config in ((3, "", SearchConfig(top=3)), (9, ", 'blosum45', -5, -2", SearchConfig(top=9, matrix="blosum45", gop=-5, gex=-2)), (0, "", SearchConfig(top=0))):
        got = spark.sql(f"SELECT * FROM align_best(TABLE(SELECT * FROM align_topk(TABLE(SELECT ref_id, residues FROM many), '{TWO[0]}', {top}{rule})), {top})").collect()
        want = search.search(asked, db, config).top_scores().collect()
        assert sorted((r.result_num, r.score, r.ref_id) for r in got) == sorted((r.result_num, r.score, r.ref_id) for r in want)


def test_queries_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(live, "ORDINALS", 8)
    rows = [(f, 3 * i + 5, f"{f}{i}", "A") for f in ("x", "y") for i in range(40)]
    got = live.numbered(spark.createDataFrame(rows, "file string, ordinal long, header string, sequence string").repartition(4)).collect()
    assert sorted((r.file, r.query_num, r.header) for r in got) == sorted((f, i, f"{f}{i}") for f in ("x", "y") for i in range(40))
