"""Quality rules from cross-document line frequency, with DataFrame functions only.

Lines are normalised and hashed; for each host the distinct documents holding a line are counted; lines above the limit
are boilerplate and removed; documents left with too little are rejected. Copies of one document would make all its lines
look like boilerplate, so a document counts by its signature, the hash of its whole text but for case and white space.
Nothing coarser will do: documents that share a template and little else are near copies by any measure of resemblance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, cut, let, words_of

#: Base rules: fewest words; percentage of words in repeated windows above which a document fails.
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "[#*$%&|<>]"
#: A line is boilerplate on a host in more than this share of its distinct documents. The share rules at every size; the
#: least number of documents is for small hosts only, where a few repeats by chance are a large share.
LINE_DOCUMENTS, LINE_SHARE = 5, 0.01
#: A document is depleted with fewer words left, or a smaller share of its words.
LEFT_WORDS, LEFT_SHARE = 20, 0.1
#: Boilerplate lines that all tasks are told at most; beyond that they are joined by shuffling.
BROADCAST_LINES = 20_000


def with_twin(ranked: Column, key: str) -> Column:
    """The places `i` of the structs whose `key` a neighbour has too; `ranked` is in order of it."""
    n = F.size(ranked)
    same = lambda k, s, at: ranked[at][key] == s[key]
    twin = lambda s, k: ((k > 0) & same(k, s, F.greatest(k - 1, F.lit(0)))) | ((k < n - 1) & same(k, s, F.least(k + 1, n - 1)))
    return F.filter(F.transform(ranked, lambda s, k: F.when(twin(s, k), s["i"])), lambda i: i.isNotNull())


def repeated_words(words: Column, windows: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more; `windows` are their hashes, which only choose whom to compare."""
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
    add = lambda acc, i: F.struct((acc["words"] + i + 3 - F.greatest(acc["end"], i)).alias("words"), (i + 3).alias("end"))
    said = lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("said"), i.alias("i"))
    covered = lambda ranked: F.aggregate(F.array_sort(with_twin(ranked, "said")), none, add)["words"]
    compared = lambda ranked: let(F.array_sort(F.transform(with_twin(ranked, "h"), said)), covered)
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ranked, compared)).cast("long")


def word_features(text: Column) -> Column:
    """n_words, word_chars and n_repeat_words; each array is made once."""

    def of_words(words: Column) -> Column:
        n = F.size(words)
        at = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
        windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>"))
        return let(windows, lambda w: F.struct(n.cast("long").alias("n_words"), F.aggregate(words, F.lit(0), lambda n, word: n + F.length(word)).cast("long").alias("word_chars"), repeated_words(words, w).alias("n_repeat_words")))

    return let(words_of(text), of_words)


def signature_of(text: Column) -> Column:
    """What copies share: a hash of the whole text, lower case and white space collapsed."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(text), GAP, " ")))


def line_hash(line: Column) -> Column:
    """Hash of the normalised line: lower case, digits alike, white space collapsed; null for a line without words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[1-9]", "0"), GAP, " "))
    return let(plain, lambda p: F.when(p != "", F.xxhash64(p)))


def duplicate_lines(lines: Column) -> Column:
    worded = F.filter(lines, lambda line: line.rlike(WORD))
    return let(worded, lambda w: (F.size(w) - F.size(F.array_distinct(w))).cast("long"))


def among(ranked: Column, value: Column) -> Column:
    """Whether an array in ascending order holds a value, by halving: an array of boilerplate may be long, and lines many."""
    steps = F.reverse(F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(ranked) + 1)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int")))
    reach = lambda v: F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ranked, at + step - 1) <= v, at + step).otherwise(at))
    return let(value, lambda v: v.isNotNull() & F.coalesce(F.get(ranked, reach(v) - 1) == v, F.lit(False)))


def boilerplate(docs: DataFrame, documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE) -> DataFrame:
    """`docs` (text, source) -> (host, line): hashed lines above the limit on their host. Null source is a host of its own."""
    text = F.coalesce("text", F.lit(""))
    seen = docs.select(F.coalesce("source", F.lit("\0")).alias("host"), signature_of(text).alias("signature"), F.array_distinct(F.transform(F.split(text, "\n"), line_hash)).alias("lines"))
    lines = seen.select("host", "signature", F.explode("lines").alias("line")).where("line is not null")
    lines = cut(lines.distinct())
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > documents)
    hosts = lines.select("host", "signature").distinct().groupBy("host").agg(F.count("*").alias("n_documents"))
    return counted.join(hosts, "host").where(F.col("n") > share * F.col("n_documents")).select("host", "line")


def assess(docs: DataFrame, documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """`docs` (doc_id, text, source, ...) -> (row struct of all columns, the measures, kept, clean_text), row for row.

    Null text has no words and fails; a null source is a host of its own; repeated rows are judged alike, as one document;
    a text of any length is judged whole, its work growing with its words and lines (and the logarithm of its host's
    boilerplate);
    an empty table gives an empty result; other columns go along in `row`, whatever their names.
    """
    bad = cut(boilerplate(docs, documents, share))
    text = F.coalesce("row.text", F.lit(""))
    lines = F.split(text, "\n")
    base = docs.select(F.struct("*").alias("row"), F.coalesce("source", F.lit("\0")).alias("host"))
    if bad.count() <= broadcast_lines:
        per_host = bad.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("bad"))
        base = base.join(F.broadcast(per_host), "host", "left")
    else:
        keyed = base.withColumn("digest", F.md5(text))
        held = keyed.select("host", "digest", F.explode(F.array_distinct(F.transform(lines, line_hash))).alias("line"))
        per_text = held.distinct().join(bad, ["host", "line"]).groupBy("host", "digest").agg(F.sort_array(F.collect_list("line")).alias("bad"))
        base = keyed.join(per_text, ["host", "digest"], "left")

    def removal(bad: Column) -> Column:
        """Which lines go: nothing is hashed where the host has no boilerplate."""
        return F.when(bad.isNull(), F.lit(None).cast("array<boolean>")).otherwise(F.transform(lines, lambda line: among(bad, line_hash(line))))

    def clean(gone: Column) -> Column:
        any_gone = F.coalesce(F.exists(gone, lambda g: g), F.lit(False))
        words_gone = F.aggregate(F.filter(lines, lambda _, i: gone[i]), F.lit(0), lambda n, line: n + F.size(words_of(line)))
        return F.struct(
            F.when(any_gone, words_gone).otherwise(F.lit(0)).cast("long").alias("words_gone"),
            F.when(any_gone, F.size(F.filter(gone, lambda g: g))).otherwise(F.lit(0)).cast("long").alias("lines_gone"),
            F.when(any_gone, F.array_join(F.filter(lines, lambda _, i: ~gone[i]), "\n")).alias("clean_text"),
        )

    measured = base.select(
        "row",
        word_features(text).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(lines).alias("n_dup_lines"),
        let(removal(F.col("bad")), clean).alias("c"),
    )
    n_words, repeated, left = F.col("w.n_words"), F.col("w.n_repeat_words"), F.col("w.n_words") - F.col("c.words_gone")
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n_words)
    depleted = (left < LEFT_WORDS) | (left < LEFT_SHARE * n_words)
    return measured.select(
        "row",
        n_words.alias("n_words"),
        F.col("w.word_chars").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        F.col("c.lines_gone").alias("n_boilerplate_lines"),
        left.alias("n_words_left"),
        F.coalesce("c.clean_text", text).alias("clean_text"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """`docs` without rejected documents and without boilerplate lines; columns as they were, n_chars brought up to date.

    Rows that share an id are judged each by its own text; an empty table stays empty.
    """
    good = assess(docs).where("kept")
    fresh = {"text": F.col("clean_text"), "n_chars": F.when(F.col("row.n_chars").isNotNull(), F.length("clean_text").cast("long")) if "n_chars" in docs.columns else None}
    return good.select([fresh[c].alias(c) if fresh.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns])


def op7(docs: DataFrame) -> DataFrame:
    return assess(docs.select("doc_id", "text", "source")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate_lines", "n_words_left"
    )


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents),
cut AS (SELECT n, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM docs),
counted AS (SELECT n, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars FROM cut),
windows AS (SELECT n, i, array_to_string(words[i:i + 2], ' ') AS said FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM cut)),
twice AS (SELECT n, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT n, i, count(*) OVER (PARTITION BY n, said) AS times FROM windows) WHERE times > 1),
repeated AS (SELECT n, count(DISTINCT pos) AS n_repeat_words FROM twice GROUP BY n),
lines AS (SELECT n, host, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS line_words,
                 trim(regexp_replace(regexp_replace(lower(line), '[1-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm,
                 trim(regexp_replace(lower(t), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS whole
          FROM (SELECT *, unnest(string_split(t, chr(10))) AS line FROM docs)),
doubled AS (SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE line_words > 0 GROUP BY n),
hosts AS (SELECT host, count(DISTINCT whole) AS documents FROM lines WHERE norm <> '' GROUP BY host),
bad AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT whole) AS held FROM lines WHERE norm <> '' GROUP BY host, norm) JOIN hosts USING (host)
        WHERE held > {LINE_DOCUMENTS} AND held > {LINE_SHARE} * documents),
gone AS (SELECT n, count(*) AS n_boilerplate_lines, sum(line_words)::BIGINT AS words_gone FROM lines JOIN bad USING (host, norm) GROUP BY n),
measured AS (
  SELECT doc_id, n_words, word_chars, length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_boilerplate_lines, 0) AS n_boilerplate_lines, n_words - coalesce(words_gone, 0) AS n_words_left
  FROM docs JOIN counted USING (n) LEFT JOIN repeated USING (n) LEFT JOIN doubled USING (n) LEFT JOIN gone USING (n))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND n_words_left >= {LEFT_WORDS} AND n_words_left >= {LEFT_SHARE} * n_words AS kept
FROM measured
"""
