"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: texts that match must hold the trigrams of
one of its mandatory strings. The index has a posting (trigram, text) for every trigram that the rules ask for; a text
is named by its digest, so copies share postings. Postings are intersected per text, which gives the candidates of each
rule; only they are scanned for it. Rules without mandatory trigrams scan all texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_of, any_of, cut, let, running


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of the match or of one of its groups."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0

    @property
    def plain(self) -> str:
        """The expression with its possessive repetitions greedy."""
        return re.sub(r"([*+}])\+(?![^\[\]]*\])", r"\1", self.pattern)


#: What follows a private key's first line: all up to its last line if no other key begins (or ends) before it; where that is
#: missing header lines and base64 as far as it goes, in lines or set apart by blanks; line ends may be written as \\n.
#: Repetitions are possessive, so that Java goes through them in a loop whatever their number; as nothing in these expressions
#: could be matched by giving back, `Rule.plain` has them greedy for engines without such, with the same matches.
OTHER = r"-{1,4}[^-]++|-{5,}+(?:[^-BE]|B[^E-]|BE[^G-]|E[^N-]|EN[^D-])[^-]*+"
TO_END = rf"[^-]*+(?:{OTHER})*+-----+END [A-Z ]*PRIVATE KEY-----"
HEADERS = r"(?:[\r\n\\]++[\t\x20]*+[A-Za-z-]++:[^\r\n\\]*+)*+"
BODY = rf"{HEADERS}(?:[\r\n\t\x20\\]*[A-Za-z0-9+/=]{{16,}}(?:[A-Za-z0-9+/=\r\n\\]*[A-Za-z0-9+/=])?(?:[\t\x20\r\n\\]++[A-Za-z0-9+/=]{{16,}}+)*+(?:[\r\n\\]+[\t\x20]*[A-Za-z0-9+/=]+)?)?"
#: The three base rules come first, in the order that breaks ties; the others are the method's own.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{TO_END}|{BODY})?"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Candidates that all tasks are told at most; more are joined with the texts by shuffling both.
BROADCAST_CANDIDATES = 500_000
#: Characters of the pieces that a text is cut into to be put together anew.
REBUILT_BLOCK = 1024
#: Strings that an expression is expanded to at most before it is cut into parts.
EXPAND = 64


def mandatory(pattern: str) -> list[set[str]]:
    """Sets of lower-case strings, one string of each set standing in every match of the expression.

    The expression is followed from left to right and expanded to the strings it can begin with; where that can't go on
    (a repetition without bound, a wide character class) the strings so far make a set, and expansion begins anew.
    """
    sets: list[set[str]] = []

    def strings(items) -> set[str] | None:
        """All that the items can match, or None if too many."""
        found = {""}
        for item in items:
            one = expand(item)
            if one is None or len(found) * len(one) > EXPAND:
                return None
            found = {a + b for a in found for b in one}
        return found

    def expand(item) -> set[str] | None:
        kind, value = str(item[0]), item[1]
        if kind == "LITERAL":
            return {chr(value).lower()}
        if kind == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            return {chr(v).lower() for _, v in value}
        if kind == "SUBPATTERN":
            return strings(value[3])
        if kind == "BRANCH":
            parts = [strings(x) for x in value[1]]
            return None if None in parts else set().union(*parts)
        if kind == "MAX_REPEAT" and value[1] is not re._constants.MAXREPEAT and value[1] <= 4:
            times = [strings(list(value[2]) * n) for n in range(value[0], value[1] + 1)]
            return None if None in times else set().union(*times)
        return None

    current: set[str] = {""}
    for item in re._parser.parse(pattern):
        one = expand(item)
        if one is not None and len(current) * len(one) <= EXPAND:
            current = {a + b for a in current for b in one}
            continue
        sets.append(current)
        current = one if one is not None else {""}
    sets.append(current)
    return [s for s in sets if all(len(x) >= 3 for x in s)]


def trigrams(text: str) -> list[str]:
    return [text[i : i + 3] for i in range(len(text) - 2)]


def boolean_query(rule: Rule) -> list[list[list[str]]]:
    """And over sets of (or over strings of (and over trigrams)); empty: no mandatory trigram."""
    return [[trigrams(s) for s in sorted(one)] for one in mandatory(rule.pattern)]


def postings(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index of `texts` (digest, text): (trigram number, digest), without repeats."""
    low = F.lower(F.col("text"))
    held = let(low, lambda t: F.filter(F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(i)) for i, g in enumerate(wanted)]), lambda i: i.isNotNull()))
    return texts.select("digest", F.explode(held).alias("trigram")).distinct()


def rules_met(rules: tuple[Rule, ...], holds: Callable[[list[str]], Column]) -> Column:
    """Bits of the indexed rules whose trigram query is satisfied; `holds` tells whether all of some trigrams are there."""
    total = F.lit(0)
    for i, rule in enumerate(rules):
        if query := boolean_query(rule):
            fits = all_of([any_of([holds(grams) for grams in one]) for one in query])
            total = total + F.when(fits, F.lit(1 << i)).otherwise(F.lit(0))
    return total


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(digest, rules: bits of the indexed rules whose trigram query the text satisfies), texts with any only."""
    queries = {i: q for i, r in enumerate(rules) if (q := boolean_query(r))}
    wanted = sorted({g for q in queries.values() for one in q for grams in one for g in grams})
    if not queries:
        return texts.select("digest", F.lit(0).alias("rules")).limit(0)
    words = range(0, len(wanted), 60)  # trigrams by their bits, 60 to a number
    number = {g: i for i, g in enumerate(wanted)}
    index = postings(texts, wanted)
    bits = [F.bit_or(F.when((F.col("trigram") >= w) & (F.col("trigram") < w + 60), F.expr(f"shiftleft(1L, trigram - {w})")).otherwise(F.lit(0).cast("long"))).alias(f"held_{w}") for w in words]
    met = index.groupBy("digest").agg(*bits)

    def holds(grams: list[str]) -> Column:
        masks = {w: sum(1 << (number[g] - w) for g in set(grams) if w <= number[g] < w + 60) for w in words}
        return all_of([F.col(f"held_{w}").bitwiseAND(m) == m for w, m in masks.items() if m])

    return met.select("digest", rules_met(rules, holds).alias("rules")).where("rules != 0")


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Spans of the rule's leftmost non-overlapping matches, in code points: array of (start, rank, kind, end).

    What lies between the matches is what splitting by the expression gives; running sums of lengths are the places.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    sizes = lambda array: F.transform(array, lambda x: F.length(x))

    def placed(found: Column) -> Column:
        steps = F.transform(found["whole"], lambda n, k: n + found["between"][k])

        def span(at: Column, k: Column) -> Column:
            start = at + found["between"][k]
            return F.struct(start.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), (start + found["whole"][k]).alias("end"))

        every = lambda starts: F.filter(F.transform(starts, span), lambda _, k: found["judged"][k] >= rule.least)
        return F.when(F.size(found["whole"]) > 0, let(running(steps, lambda a, b: a + b), every)).otherwise(F.array().cast(SPANS))

    return let(F.struct(sizes(whole).alias("whole"), sizes(judged).alias("judged"), sizes(F.split(text, rule.pattern)).alias("between")), placed)


def scan_pattern(rule: Rule) -> Rule:
    """The rule with its least length inside the expression, where that finds the same spans: a run of one class."""
    if rule.group == 0 and rule.least > 1 and (m := re.fullmatch(r"(\w*)(\[[^\]]+\])\+", rule.pattern)):
        return Rule(rule.kind, f"{m[1]}{m[2]}{{{rule.least - len(m[1])},}}")
    return rule


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_candidates: int = BROADCAST_CANDIDATES) -> DataFrame:
    """`docs` (text, ...) -> (row struct of all columns, text, spans), row for row; spans by start, then rule order.

    Null text counts as empty. Postings are by the text's digest, so repeated rows and copies are indexed once. Other
    columns go along in `row`, whatever their names; an empty table gives an empty result. The work on one text grows
    with its length and the number of its secrets, in proportion.
    """
    base = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = base.withColumn("digest", F.md5("text"))
    met = cut(candidates(keyed.select("digest", "text"), rules))
    met = F.broadcast(met) if met.count() <= broadcast_candidates else met
    keyed = keyed.join(met, "digest", "left").withColumn("rules", F.coalesce("rules", F.lit(0)))
    parts = []
    for i, rule in enumerate(rules):
        spans = spans_of(F.col("text"), scan_pattern(rule), i)
        indexed = bool(boolean_query(rule))
        parts.append(F.when(F.col("rules").bitwiseAND(1 << i) != 0, spans).otherwise(F.array().cast(SPANS)) if indexed else spans)
    return keyed.select("row", "text", F.array_sort(F.concat(*parts)).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each secret replaced by its kind in square brackets; overlapping spans go together under the first."""
    block = REBUILT_BLOCK

    def rebuilt(text: Column, spans: Column) -> Column:
        def from_blocks(blocks: Column) -> Column:
            def between(a: Column, b: Column) -> Column:
                """Characters a to b, from the blocks that hold them."""
                first, last = F.floor(a / block).cast("int"), F.floor(b / block).cast("int")
                head, tail = F.substring(F.get(blocks, first), a % block + 1, block), F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), b % block)
                middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
                return F.when(b <= a, "").when(first == last, F.substring(F.get(blocks, first), a % block + 1, b - a)).otherwise(F.concat(head, middle, tail))

            def joined(upto: Column) -> Column:
                """upto: where the spans before each one have ended."""
                pieces = F.transform(spans, lambda s, k: F.when(s["start"] >= upto[k], F.concat(between(upto[k], s["start"]), F.lit("["), s["kind"], F.lit("]"))))
                end = F.array_max(F.transform(spans, lambda s: s["end"]))
                return F.concat(F.array_join(F.filter(pieces, lambda p: p.isNotNull()), ""), between(end, F.length(text)))

            return let(running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), joined)

        return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), from_blocks)).otherwise(text)

    found = find(docs).select("row", F.col("row.text").alias("was"), rebuilt(F.col("text"), F.col("spans")).alias("now"), F.size("spans").alias("n"))
    fresh = {"text": F.when(F.col("n") > 0, F.col("now")).otherwise(F.col("was"))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("n") > 0, F.length("now").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select([fresh[c].alias(c) if c in fresh else F.col("row")[c].alias(c) for c in docs.columns])


def op5(docs: DataFrame) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    found = find(docs.select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """`op5` in DuckDB, every rule scanning every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    scans = " UNION ALL ".join(
        f"SELECT n, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {quote(r.plain)}) AS gaps, regexp_extract_all(t, {quote(r.plain)}, 0) AS whole, regexp_extract_all(t, {quote(r.plain)}, {r.group}) AS judged FROM docs"
        for i, r in enumerate((scan_pattern(r) for r in rules))
    )
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
places AS (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM ({scans})),
spans AS (
  SELECT n, rank, kind, start, start + length(whole[k]) AS stop FROM (
    SELECT *, (list_sum(list_transform(gaps[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:k - 1], lambda x: length(x))), 0))::BIGINT AS start FROM places)
  WHERE length(judged[k]) >= least),
found AS (SELECT n, {counts}, {listed} FILTER (rank < {len(BASE)}) AS base, {listed} AS spans FROM spans GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (n)
"""
