"""Personal data, and the terms that give it away: information-theoretic sanitisation.

Personal data of a fixed form (mail and network addresses, card and phone numbers) is found by its form. Such a value is
a protected entity; what else in the corpus reveals it is told by co-occurrence. With N different texts, n(e) of which
hold the entity e, n(t) the term t and n(t, e) both, the entity alone carries log2(N / n(e)) bits, and who reads the term
lacks -log2(n(t, e) / n(t)) of them. A term that leaves hardly anything uncertain discloses the entity and is removed; one
that leaves little is generalised. Both need evidence, a least number of different texts, and a term must tell at least
half of what the entity carries, so that nothing reveals a value that stands nearly everywhere.

Counts are over all texts, copies once, and come from three passes: the first takes the terms of texts that hold personal
data, the second counts the terms in question everywhere, the third writes the spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, small_or_not

#: The base kinds in their order, then the method's: terms to remove, terms to generalise.
BASE, ADDED = ("email", "ip", "card", "phone"), ("disclosing", "hinting")
#: Different texts that must hold a term and the entity together.
SUPPORT = 5
#: Tenths of a term's texts that hold the entity, at least, for the term to be removed and to be generalised: 0.15 and 0.5 bits left.
REMOVE, GENERALISE = 9, 7
#: Terms that all tasks are told at most, and bytes of them; more are joined with the texts.
MOST_TOLD, MOST_BYTES = 500_000, 16 << 20
#: Bytes of text that a task works on at once.
BATCH = 4 << 20
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The base kinds' forms. Only `+`, a digit run's beginning or `@` can begin or be in a match, which keeps the
# search linear: a digit run that fails from its first digit fails from every later one.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"[0-9]++")
WORD = re.compile(r"\w+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What can stand before an `@` is followed leftwards, no farther than the match before."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    place = 0
    while run := RUN.search(text, place):
        found = ADDRESS.match(text, run.start())
        place = found.end() if found else run.end()
        if found and all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in found[0].split("."))):
            yield found.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in NUMBER.finditer(text):
        if found.end() - found.start() <= 37 and 13 <= len(digits := re.sub("[^0-9]", "", found[0])) <= 19:
            twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            if sum(d - 9 * (d > 9) for d in twice) % 10 == 0:
                yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for found in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in found[0]) <= 15:
            yield found.span()


FINDERS = (emails, addresses, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start; ends exclusive, in code points."""
    return [(k, *span) for k, find in enumerate(FINDERS) for span in find(text)]


def entity(kind: int, value: str) -> str:
    """A value as it is compared: numbers by their digits, addresses without regard to case."""
    return f"{BASE[kind]}:{value.lower() if kind < 2 else re.sub('[^0-9]', '', value)}"


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words that no span of personal data touches, lower-cased."""
    taken = sorted((a, b) for _, a, b in spans)
    k, upto = 0, 0
    for word in WORD.finditer(text):
        while k < len(taken) and taken[k][0] < word.end():
            upto = max(upto, taken[k][1])
            k += 1
        if word.start() >= upto:
            yield word[0].lower(), word.start(), word.end()


def terms_in(text: str) -> set[str]:
    return {w.lower() for w in set(WORD.findall(text))}


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in slices(batches, "text", BATCH):
        yield batch, batch.column("text").to_pylist()


def cases(texts: DataFrame) -> DataFrame:
    """`texts` (key, text) -> (key, entities, terms) of those that hold personal data, each different one once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, told in texts_of(batches):
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), told, strict=True):
                if spans := base_spans(text):
                    rows.append((key, sorted({entity(k, text[a:b]) for k, a, b in spans}), sorted({w for w, *_ in words_outside(text, spans)})))
            if rows:
                kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "entities", "terms"])

    return texts.mapInArrow(run, "key string, entities array<string>, terms array<string>").dropDuplicates(["key"])


def holding(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """`texts` (key, text), `wanted` (term) -> (key, term): which texts hold which of the terms, outside personal data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, told in texts_of(batches):
            keys, found = [], []
            for key, text in zip(batch.column("key").to_pylist(), told, strict=True):
                own = sorted({w for w, *_ in words_outside(text, base_spans(text))})
                keys += [key] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["key", "term"])

    return texts.mapInArrow(run, "key string, term string").join(wanted, "term", "left_semi").select("key", "term")


def counted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_t): how many of the texts, each a different one, hold each of the terms outside personal data.

    A task sums up for all its texts before anything leaves it, for the wanted terms where they are few; else it sums up
    for the terms of some texts at a time, and those not wanted go after the sums.
    """
    terms = few(wanted)
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(terms)) if terms is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["term", "n"])
            sums.clear()
            return made

        for _, some in texts_of(batches):
            for text in some:
                spans = base_spans(text)
                own = {w for w, *_ in words_outside(text, spans)} if spans else terms_in(text)
                sums.update(own if shared is None else own & shared.value)
            if len(sums) > MOST_TOLD:
                yield told()
        yield told()

    found = texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return found if terms is not None else found.join(wanted, "term", "left_semi")


def few(terms: DataFrame) -> list | None:
    """The rows' values where they are few enough to be told to all tasks."""
    n, size = terms.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    return [r[0] if len(r) == 1 else tuple(r) for r in terms.collect()] if n <= MOST_TOLD and (size or 0) <= MOST_BYTES else None


def disclosing(docs: DataFrame, support: int = SUPPORT, remove: int = REMOVE, generalise: int = GENERALISE) -> DataFrame:
    """(term, kind) of the terms that give away personal data in `docs` (text): `disclosing` or `hinting`.

    Entities that stand in the same texts are one, named by the least, so that a list that is copied around does not
    multiply. A text adds a row for each of its entities' classes and each of its terms, summed before the shuffle.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    known = cut(cases(texts))
    held = known.select("key", F.explode("entities").alias("entity"))
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "key"))
    entities = held.groupBy("entity").agg(F.count("*").alias("n_e"), mark(1).alias("m1"), mark(2).alias("m2")).where(F.col("n_e") >= support)
    classes = entities.groupBy("n_e", "m1", "m2").agg(F.min("entity").alias("entity")).select("entity", "n_e")
    protected = held.join(small_or_not(cut(classes), 200_000), "entity").groupBy("key").agg(F.collect_list(F.struct("entity", "n_e")).alias("classes"))
    pairs = known.join(protected, "key").select(F.explode("classes").alias("c"), "terms").select("c.entity", "c.n_e", F.explode("terms").alias("term"))
    together = cut(pairs.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support))
    if together.isEmpty():
        return together.select("term", F.lit("").alias("kind"))
    wanted = cut(together.select("term").distinct())
    copies = cut(texts.groupBy("key").agg(F.count("*").alias("copies")))
    every, again = copies.count(), small_or_not(copies.where("copies > 1").select("key"), 500_000)
    # Only texts that have copies are shuffled, to leave one of each.
    different = texts.join(again, "key", "left_anti").unionByName(texts.join(again, "key", "left_semi").dropDuplicates(["key"]))
    everywhere = counted(different, wanted)
    judged = together.join(everywhere, "term").where(F.col("n_te").cast("double") * F.col("n_te") * every >= F.col("n_e").cast("double") * F.col("n_t") * F.col("n_t"))
    share = judged.groupBy("term").agg(F.max(F.col("n_te") * 10 >= F.col("n_t") * remove).alias("gone"), F.max(F.col("n_te") * 10 >= F.col("n_t") * generalise).alias("vague"))
    return cut(share.where("gone or vague").select("term", F.when(F.col("gone"), ADDED[0]).otherwise(ADDED[1]).alias("kind")))


def find(docs: DataFrame, support: int = SUPPORT, remove: int = REMOVE, generalise: int = GENERALISE) -> DataFrame:
    """`docs` (text, ...) -> (row struct of all columns, text, spans), row for row; spans by kind, then start.

    Null text is an empty one without spans. Repeated rows get the same spans; copies count once as evidence, and where
    rows share an id nothing changes, as texts are told apart by their digest. Other columns go along in `row`, whatever
    their names. Texts of any length are scanned whole in time proportional to their length; an empty table gives an empty
    result. A term is only looked for outside personal data. Ties do not arise: every comparison is of counts.
    """
    base = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    terms = disclosing(docs, support, remove, generalise)
    schema = T.StructType([*base.schema.fields, T.StructField("spans", T._parse_datatype_string(SPANS))])
    told = few(terms)
    if told is None:
        keyed = base.withColumn("key", F.md5("text"))
        every = cut(holding(keyed.select("key", "text"), terms.select("term")).distinct())
        own = every.join(terms, "term").groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("term", "kind")).alias("told"))
        base = keyed.join(own, F.col("key") == F.col("of"), "left").select("row", "text", "told")
    shared = docs.sparkSession.sparkContext.broadcast(dict(told)) if told is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            rows = [None] * len(texts) if shared is not None else batch.column("told").to_pylist()
            out = []
            for text, own in zip(texts, rows, strict=True):
                kinds = shared.value if shared is not None else {x["term"]: x["kind"] for x in own or ()}
                spans = base_spans(text)
                marked = [(BASE[k], a, b) for k, a, b in spans]
                if kinds and not kinds.keys().isdisjoint(terms_in(text)):
                    marked += sorted((kinds[w], a, b) for w, a, b in words_outside(text, spans) if w in kinds)
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in marked])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(out, kind)], ["row", "text", "spans"])

    return base.mapInArrow(run, schema)


def sanitise(docs: DataFrame, support: int = SUPPORT, remove: int = REMOVE, generalise: int = GENERALISE) -> DataFrame:
    """`docs` with personal data replaced by its kind in brackets, disclosing terms removed and hinting ones generalised.

    A generalised number becomes `[number]`, a capitalised word `[name]`, another `[word]`. Overlapping spans go together
    under the first, the longer of two that begin together. Null texts stay null; edge cases are those of `find`.
    """

    @F.pandas_udf("string")
    def rewritten(texts, spans):
        import pandas as pd

        def general(word: str) -> str:
            return "[number]" if word[:1].isdigit() else "[name]" if word[:1].isupper() else "[word]"

        def one(text: str, found) -> str:
            out, done = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= done:
                    word = text[s["start"] : s["end"]]
                    out += [text[done : s["start"]], f"[{s['kind']}]" if s["kind"] in BASE else "" if s["kind"] == ADDED[0] else general(word)]
                done = max(done, s["end"])
            return "".join([*out, text[done:]])

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype="object")

    fresh = F.when(F.col("row.text").isNotNull(), rewritten("text", "spans"))
    return find(docs, support, remove, generalise).select([fresh.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12(docs: DataFrame) -> DataFrame:
    """A row for each document: numbers of base spans of each kind, their digest, and all spans."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return find(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def oracle() -> str:
    """`op12` in DuckDB, from the expressions as they are stated."""
    forms = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(said, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) <= 255))"),
        ("card", r"[0-9]([\x20-]?[0-9])+", "length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(digits), i::INTEGER, 1)::INTEGER ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(reverse(digits), i::INTEGER, 1)::INTEGER + 1] END)) % 10 = 0"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15"),
    )
    word = r"[\p{L}\p{N}_]+"
    at = lambda p, rest: f"SELECT n, {rest}, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS whole FROM texts"
    placed = "(list_sum(list_transform(gaps[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:k - 1], lambda x: length(x))), 0))::BIGINT AS start, whole[k] AS said"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
texts AS (SELECT row_number() OVER () AS n, t FROM (SELECT DISTINCT t FROM docs)),
matches AS (SELECT n, rank, kind, {placed} FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM ({" UNION ALL ".join(at(p, f"{i} AS rank, '{k}' AS kind") for i, (k, p, _) in enumerate(forms))}))),
spans AS (SELECT *, start + length(said) AS stop FROM (SELECT *, regexp_replace(said, '[^0-9]', '', 'g') AS digits FROM matches) WHERE CASE kind {" ".join(f"WHEN '{k}' THEN {fits}" for k, _, fits in forms)} END),
entities AS (SELECT DISTINCT n, kind || ':' || CASE WHEN kind IN ('email', 'ip') THEN lower(said) ELSE digits END AS entity FROM spans),
words AS (SELECT n, start, start + length(said) AS stop, lower(said) AS term FROM (SELECT n, {placed} FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM ({at(word, "0 AS rank")})))),
clear AS (SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.n = w.n AND s.start < w.stop AND w.start < s.stop)),
terms AS (SELECT DISTINCT n, term FROM clear),
n_t AS (SELECT term, count(*) AS n_t FROM terms GROUP BY term),
n_e AS (SELECT entity, count(*) AS n_e FROM entities GROUP BY entity),
pairs AS (SELECT entity, term, count(*) AS n_te FROM entities JOIN terms USING (n) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
judged AS (SELECT term, max(10 * n_te >= {REMOVE} * n_t) AS gone FROM pairs JOIN n_t USING (term) JOIN n_e USING (entity)
           WHERE n_te::DOUBLE * n_te * (SELECT count(*) FROM texts) >= n_e::DOUBLE * n_t * n_t AND 10 * n_te >= {GENERALISE} * n_t GROUP BY term),
added AS (SELECT n, CASE WHEN gone THEN '{ADDED[0]}' ELSE '{ADDED[1]}' END AS kind, start, stop FROM clear JOIN judged USING (term)),
every AS (SELECT n, rank, kind, start, stop FROM spans UNION ALL SELECT n, CASE WHEN kind = '{ADDED[0]}' THEN 4 ELSE 5 END, kind, start, stop FROM added),
told AS (SELECT n, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) FILTER (rank < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) AS spans FROM every GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs JOIN texts USING (t) LEFT JOIN told USING (n)
"""


ORACLE = oracle()
