"""Personal data and the terms that give it away, against a plain version with the expressions as they are stated."""

import hashlib
import random
import re
import time
from collections import defaultdict

import duckdb
import pytest

from seqscan.llm import disclosure

SCHEMA = "doc_id long, text string, row string, spans string, term string, key string"
EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0


def plain_base(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    fits = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, good) in fits.items() for m in re.finditer(p, text) if good(m)]


def plain(rows, support, remove, generalise):
    texts = {t or "" for _, t in rows}
    spans = {t: plain_base(t) for t in texts}
    clear = lambda t: [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", t) if not any(a < m.end() and m.start() < b for _, a, b in spans[t])]
    terms = {t: clear(t) for t in texts}
    with_term, with_entity = defaultdict(set), defaultdict(set)
    for t in texts:
        for w, *_ in terms[t]:
            with_term[w].add(t)
        for k, a, b in spans[t]:
            with_entity[k, t[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", t[a:b])].add(t)
    kinds = {}
    for w, own in with_term.items():
        for held in with_entity.values():
            both = len(own & held)
            if both >= support and both * both * len(texts) >= len(held) * len(own) ** 2 and 10 * both >= generalise * len(own):
                strong = 10 * both >= remove * len(own)
                kinds[w] = "disclosing" if strong or kinds.get(w) == "disclosing" else "hinting"
    out = []
    for i, t in rows:
        t = t or ""
        added = sorted((kinds[w], a, b) for w, a, b in terms[t] if w in kinds)
        said = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        n = [sum(k == x for k, *_ in spans[t]) for x in ("email", "ip", "card", "phone")]
        out.append((i, *n, hashlib.sha256(said(spans[t]).encode()).hexdigest(), said(spans[t] + added)))
    return sorted(out, key=str)


def documents(seed):
    r = random.Random(seed)
    people = [(f"nick{k}", f"u{k}.x@mail{k}.example.org", f"+1 (555) 010-{k:04d}", f"10.0.{k}.7", f"job{k}") for k in range(6)]
    rows = []
    for i in range(150):
        words = [f"w{r.randrange(60)}" for _ in range(r.randrange(1, 30))]
        if r.random() < 0.5:
            nick, mail, phone, ip, job = r.choice(people)
            words += [r.choice([mail, mail, mail.upper()]), nick if r.random() < 0.95 else "Hm"] + [phone] * (r.random() < 0.5) + [ip] * (r.random() < 0.5)
            words += [job] * (r.random() < 0.6)
        words += [f"job{r.randrange(6)}"] * (r.random() < 0.1)
        r.shuffle(words)
        rows.append((i, " ".join(words)))
    odd = ["", None, "a@b", "a@b.c@d.e.", "x@y@z.org", "1.2.3.4.5.6.7.8", "999.1.1.1 00255.0.0.1", "4111 1111-1111 1111 4111111111111112", "+1-(2).3 4567890 +12", "é+49 30 1234567é 4111111111111111", "%@-.-..q", "a.b@c.d_e@f.g"]
    return rows + [(1000 + k, t) for k, t in enumerate(odd)] + rows[:20]


@pytest.mark.parametrize(("seed", "told"), [(1, True), (2, True), (2, False)])
def test_spans_equal_plain_version(spark, monkeypatch, seed, told):
    if not told:
        monkeypatch.setattr(disclosure, "MOST_TOLD", 0)
    rows = documents(seed)
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA).repartition(3)
    want = plain(rows, disclosure.SUPPORT, disclosure.REMOVE, disclosure.GENERALISE)
    assert any("disclosing" in w[-1] for w in want) and any("hinting" in w[-1] for w in want)
    assert sorted((tuple(x) for x in disclosure.op12(df).collect()), key=str) == want


@pytest.mark.parametrize("seed", range(5))
def test_base_spans_equal_the_expressions(seed):
    r = random.Random(seed)
    for _ in range(4000):
        text = "".join(r.choice("a1+@. -(é5_%\n4") for _ in range(r.randrange(25)))
        assert [(disclosure.BASE[k], a, b) for k, a, b in disclosure.base_spans(text)] == plain_base(text)


def test_long_texts_in_linear_time():
    began = time.perf_counter()
    for unit in ("a", "1", "1.", "+1", "+1 ", "a@", "@", "1 ", "a.b@c.", "+"):
        disclosure.base_spans(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 20


def test_sanitised_texts(spark):
    rows = [(i, f"Ann{i % 2} wrote to me@a.org about x{i} and Zed") for i in range(8)] + [(9, "Ann1 or not"), (10, None)]
    rows += [(20 + i, f"nothing here {i}") for i in range(90)]
    got = dict(disclosure.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0] == "Ann0   [email]  x0  " and got[10] is None and got[25] == "nothing here 5"
    few = {i: t for i, t in disclosure.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), support=4, remove=10).collect()}
    assert few[9] == "[name] or not" and few[0].startswith("   [email]")


def test_empty_table(spark):
    assert disclosure.op12(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table_equals_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(x) for x in disclosure.op12(docs).collect()), key=str) == plain(rows, disclosure.SUPPORT, disclosure.REMOVE, disclosure.GENERALISE)


def test_equals_sql(spark, sf_dir, tmp_path):
    spark.createDataFrame(documents(3), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/made")
    for where in (f"{sf_dir}/documents.parquet", f"{tmp_path}/made/*.parquet"):
        got = disclosure.op12(spark.read.parquet(where))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS FROM '{where}'")
        want = con.sql(disclosure.ORACLE)
        assert sorted(want.columns) == sorted(got.columns)
        rows = sorted(want.fetchall(), key=str)
        assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == rows
    assert any("hinting" in str(r) for r in rows) and any("disclosing" in str(r) for r in rows)
