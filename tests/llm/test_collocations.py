"""Phrase collocations, against counting every run of words."""

import random
import re
from collections import Counter

import duckdb
import pytest

from seqscan.llm import collocations

SCHEMA = "text string, lang string, phrase string, block long, n long"


def plain(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    out = {}
    for (lang, words), a in f.items():
        if len(words) > 1:
            cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            inside = lambda longer: any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
            if not any(c >= a and x == lang and len(p) > len(words) and inside(p) for (x, p), c in f.items()):
                out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))  # noqa: E741


def documents(seed):
    r = random.Random(seed)
    runs = ["New York City", "of the", "a a a a", "Émile Zola", "x y z", "to be or not to be"]
    rows = []
    for _ in range(120):
        words = [r.choice(runs) if r.random() < 0.4 else f"w{r.randrange(25)}" for _ in range(r.randrange(60))]
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]) for w in words)
        rows.append((text, r.choice(["en", "en", "de", None, "und"])))
    return [(t, x, "p", 1, 2) for t, x in [*rows, *rows[:10], (None, "en"), ("", None), (" \t.\n", "xx"), ("solo", "yy")]]


@pytest.mark.parametrize(("seed", "block", "told"), [(1, 1 << 20, True), (2, 300, True), (2, 300, False), (3, 2000, False)])
def test_collocations_equal_plain_version(spark, monkeypatch, seed, block, told):
    if not told:
        monkeypatch.setattr(collocations, "MOST_TOLD", 0)
    rows = documents(seed)
    got = collocations.op11(spark.createDataFrame(rows, SCHEMA).repartition(3), least=6, top=30, block=block).collect()
    want = plain(rows, 6, 30)
    assert len(want) > 40 and any(len(w[2].split(" ")) == 5 for w in want)
    assert sorted(map(tuple, got)) == want


def test_very_long_text_and_empty_table(spark):
    text = "one two three four five six. " * 60_000
    df = spark.createDataFrame([(text, "en", "p", 1, 2)], SCHEMA)
    assert sorted(map(tuple, collocations.op11(df).collect())) == plain([(text, "en")], 100, 2000)
    assert collocations.op11(spark.createDataFrame([], SCHEMA)).collect() == []


def test_products_pass_64_bits(spark, monkeypatch):
    many = 10**13
    found = spark.createDataFrame([("en", "a", 1, many), ("en", "b", 1, many), ("en", "a b", 2, many // 2)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 3 * many)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequencies", lambda *_: (totals, found))
    assert [tuple(r) for r in collocations.collocations(found).collect()] == [("en", "a b", many // 2, many, many, 3 * many, 1500)]


def test_equals_sql(spark, sf_dir):
    got = collocations.op11(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    want = con.sql(collocations.ORACLE)
    assert sorted(want.columns) == sorted(got.columns)
    rows = sorted(want.fetchall())
    assert rows and sorted(map(tuple, got.select(want.columns).collect())) == rows
