"""The pipeline's stages, each on what the one before it kept."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_copies import plain_fingerprint
from tests.llm.test_rules import PLAIN, plain_base, plain_spans


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(docs.collect())
    source = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good, unique, safe, mix, tokens = seen
    failed = {i for i, r in source.items() if plain_base(r.text)[5]}
    kept = {r.doc_id for r in good}
    assert not failed & kept and len(kept) > 0.9 * (len(source) - len(failed))
    prints = {r.doc_id: plain_fingerprint(r.text) for r in good}
    left = {r.doc_id for r in unique}
    groups = {i: i for i in prints}
    for _ in range(3):
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    groups[i] = groups[j] = min(groups[i], groups[j])
    assert left == set(groups.values())
    assert all(plain_spans(r.text, PLAIN) == "" for r in safe) and len(safe) == len(unique)
    assert {r.doc_id for r in mix} <= left and len(tokens) == len(mix)
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(tokens)


#: Columns with the names that the stages use themselves.
ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, host string, bad string, fp long, copy int, tokens int, spans string, digest string, __id long, __row string"


def odd_rows():
    r = random.Random(21)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    clash = ("a", "b", "c", 1, 2, 3, "d", "e", 4, "f")
    twice = (1, say(80), "en", "web", 7, *clash)
    rows = [twice, twice, (2, None, None, None, None, *clash), (3, "", "", "", 0, *clash), (4, say(200_000), "en", "web", 1, *clash)]
    rows += [(None, say(90), None, None, None, *[None] * 10), (5, say(70), "en", None, None, *clash), (5, say(70) + " password=abcdefgh1234", "en", "web", None, *clash)]
    return rows


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_odd_tables(spark, sf_dir, name, stage):
    rows = odd_rows()
    last = name == corpus_pipeline.STAGES[-1][0]
    out = stage(spark, spark.createDataFrame(rows, ODD).repartition(3), sf_dir)
    got = out.collect()
    none = stage(spark, spark.createDataFrame([], ODD), sf_dir)
    assert none.collect() == [] and none.dtypes == out.dtypes
    if last:
        assert len(got) == len(rows) and "doc_id" in out.columns
        return
    assert out.columns == spark.createDataFrame([], ODD).columns
    by_id = lambda i: [x for x in got if x.doc_id == i]
    assert all(x.row == "a" and x["__id"] == 4 for x in got if x.doc_id is not None)
    if name in ("quality rules", "secret scans"):
        gone = {2, 3} if name == "quality rules" else set()
        assert len(got) == len(rows) - len(gone) and not gone & {x.doc_id for x in got}
    if name == "simhash near-dedup":
        assert [len(by_id(i)) for i in (1, 2, 3, 4, 5, None)] == [1, 1, 0, 1, 2, 1]
    if name == "secret scans":
        assert sum("[assign]" in (x.text or "") for x in got) == 1 and not any("abcdefgh1234" in (x.text or "") for x in got)


def test_run_of_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame(odd_rows(), ODD).repartition(3).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([], ODD).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert {x.doc_id for x in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()} <= {1, 4, 5, None}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
