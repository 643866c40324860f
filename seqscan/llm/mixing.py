"""Mixing sources to target weights by temperature, with DataFrame functions only.

The weight of a source is its token share to the power of an exponent, normalised. The exponent is bisected on [0, 1]:
for the largest one whose weights still have the target entropy, then, if some source would be repeated more often than
allowed, for the least one that keeps to the limit. The mixture is realised within a token budget: a source gives whole
epochs of its documents, each in an order of its own, then those of one more epoch that fit into what is left, first come
first served, and the schedule's blocks take each source's documents in proportion, permuted within the block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_or_not, words_of

#: Target entropy as a share of the largest possible; how often a source may be repeated; tokens of a block; seed.
ENTROPY_SHARE, REPETITIONS, BLOCK_TOKENS, SEED = 0.98, 2.0, 1 << 16, 17
#: Documents of a source that one task puts in order, about.
BUCKET_DOCUMENTS = 5_000
#: Levels of bisection read off one aggregate, and how many aggregates.
LEVELS, PASSES = 5, 6


def source_tokens(docs: DataFrame) -> DataFrame:
    """(source, tokens, documents): words of whole texts. Null source is a source of its own, written as empty."""
    return docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))


def exact(c: Column) -> Column:
    """A number whose sum does not depend on the order of adding."""
    return c.cast("decimal(38,18)")


def spread(sources: DataFrame, exponents: list[float], total: int) -> list[tuple[float, float]]:
    """For each exponent the entropy of the weights and the largest weight by share."""
    share = F.col("tokens") / F.lit(total)
    sums = []
    for k, a in enumerate(exponents):
        power = F.pow(share, F.lit(a))
        sums += [F.sum(exact(power)).alias(f"z{k}"), F.sum(exact(power * F.log(share) * a)).alias(f"s{k}"), F.max(F.pow(share, F.lit(a - 1.0))).alias(f"m{k}")]
    r = sources.agg(*sums).first()
    return [(math.log(r[f"z{k}"]) - float(r[f"s{k}"]) / float(r[f"z{k}"]), r[f"m{k}"] / float(r[f"z{k}"])) for k in range(len(exponents))]


def bisected(sources: DataFrame, total: int, fits, keep_low: bool) -> float:
    """The border on [0, 1] between exponents for which `fits` holds and others; one aggregate serves LEVELS halvings."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        n = 1 << LEVELS
        points = [low + (high - low) * i / n for i in range(1, n)]
        holds = [fits(*x) for x in spread(sources, points, total)]
        a, b = 0, n
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if holds[mid - 1] == keep_low else (a, mid)
        low, high = low + (high - low) * a / n, low + (high - low) * b / n
    return low if keep_low else high


def exponent(sources: DataFrame, entropy_share: float = ENTROPY_SHARE, repetitions: float = REPETITIONS, budget: int | None = None) -> float:
    """The exponent for `sources` (source, tokens > 0); 1 keeps the shares, 0 makes all sources equal."""
    known = sources.agg(F.sum("tokens"), F.count("*")).first()
    total, n = known[0] or 0, known[1]
    if n < 2:
        return 1.0
    target = entropy_share * math.log(n)
    ends = spread(sources, [0.0, 1.0], total)
    a = 1.0 if ends[1][0] >= target else bisected(sources, total, lambda h, m: h >= target, True)
    repeated = lambda m: (budget if budget is not None else total) / total * m <= repetitions
    if not repeated(spread(sources, [a], total)[0][1]):
        a = max(a, bisected(sources, total, lambda h, m: repeated(m), False)) if repeated(ends[1][1]) else 1.0
    return a


def weights(sources: DataFrame, a: float) -> DataFrame:
    """`sources` with a weight column, rounded to nine digits."""
    z = sources.where("tokens > 0").agg(F.sum(exact(F.pow(F.col("tokens").cast("double"), F.lit(a))))).first()[0]
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(float(z or 1))).otherwise(F.lit(0.0))
    return sources.withColumn("weight", F.round(power, 9))


def order_key(*parts: Column) -> Column:
    """A permutation's key: the seed and the parts, digested."""
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), *parts))


def running_tokens(docs: DataFrame, by: list[str], key: str, n_buckets: Column) -> DataFrame:
    """`docs` with before: the tokens ahead of a row within its group in order of `key` (32 hex digits).

    Groups are cut into buckets by the key's first digits; sums over buckets are added to sums within one, so that no
    task orders a whole group.
    """
    at = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    cutted = docs.withColumn("bucket", F.floor(at * n_buckets / F.lit(float(1 << 32))).cast("long"))
    sums = cutted.groupBy(*by, "bucket").agg(F.sum("tokens").alias("bucket_tokens"))
    ahead = sums.select(*by, "bucket", (F.sum("bucket_tokens").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("bucket_tokens")).alias("ahead"))
    within = Window.partitionBy(*by, "bucket").orderBy(key, "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = cutted.withColumn("upto", F.sum("tokens").over(within))
    return summed.join(ahead, [*by, "bucket"]).withColumn("before", F.col("ahead") + F.col("upto") - F.col("tokens")).drop("bucket", "upto", "ahead")


def first_fit(rows: DataFrame) -> DataFrame:
    """`rows` (source, tokens, key, rest, n_buckets, ...): those that fit when a source's rows come in order of `key` and each is
    taken if it has no more tokens than are left of `rest`.

    All rows up to the first that does not fit are taken at once; of those after it only the ones that are no larger than
    what is left then can ever fit, and with them it goes on. What is left falls below the first one's size each time.
    """
    taken = None
    while True:
        placed = cut(running_tokens(rows, ["source"], "key", F.col("n_buckets")).withColumn("fits", F.col("before") + F.col("tokens") <= F.col("rest")).drop("before"))
        fitting = placed.where("fits").drop("fits")
        taken = fitting if taken is None else taken.unionByName(fitting)
        given = fitting.groupBy("source").agg(F.sum("tokens").alias("given"))
        given = small_or_not(given, 100_000)
        left = placed.where("not fits").drop("fits").join(given, "source", "left").withColumn("rest", F.col("rest") - F.coalesce("given", F.lit(0))).drop("given")
        rows = cut(left.where("tokens <= rest"))
        if rows.isEmpty():
            return taken


def schedule(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, repetitions: float = REPETITIONS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """`mix`, and `name`: the digest of the text of rows without doc_id."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("tokens"), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))).otherwise("").alias("name"))
    rows = cut(rows.where("tokens > 0"))
    sources = cut(source_tokens(rows))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    weighed = weights(sources, exponent(sources, entropy_share, repetitions, budget))
    quota = F.floor(F.col("weight") * F.lit(float(budget))).cast("long")
    plan = weighed.select("source", F.col("tokens").alias("source_tokens"), "documents", quota.alias("quota"), F.floor(quota / F.col("tokens")).cast("long").alias("epochs"))
    plan = small_or_not(cut(plan), 100_000)
    planned = rows.join(plan, "source").withColumn("n_buckets", F.ceil(F.col("documents") / BUCKET_DOCUMENTS)).drop("documents")
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("name"))
    keyed = lambda df: df.withColumn("key", order_key(F.col("copy").cast("string"), name))
    whole = keyed(planned.where("epochs > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1))))
    partial = keyed(planned.withColumn("copy", F.col("epochs"))).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("source_tokens"))
    copies = running_tokens(whole.unionByName(first_fit(partial.where("tokens <= rest")).drop("rest")), ["source", "copy"], "key", F.col("n_buckets"))
    n_blocks = max(1, -(-budget // block_tokens))
    # Epochs follow each other in the schedule; a place in the source's quota is a place in the schedule.
    done = F.col("copy") * F.col("source_tokens") + F.col("before")
    block = F.least(F.floor(done * n_blocks / F.col("quota")), F.lit(n_blocks - 1)).cast("long")
    blocked = copies.withColumn("block", block).withColumn("shuffled", order_key(F.col("block").cast("string"), F.col("copy").cast("string"), name))
    place = F.row_number().over(Window.partitionBy("block").orderBy("shuffled", "doc_id", "tokens", "copy")) - 1
    return blocked.withColumn("place", place.cast("long")).select("doc_id", "name", "source", "tokens", "copy", "block", "place")


def mix(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, repetitions: float = REPETITIONS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """`docs` (doc_id, text, source) -> (doc_id, source, tokens, copy, block, place): the realised schedule.

    budget: tokens of the mixture, by default as many as there are. A document takes part once for each whole epoch of
    its source and once more if it is among those of one more epoch that fit into the rest of the quota (`first_fit`): what
    a source falls short of its quota is less than the least of its documents that stay out of that epoch. `copy` counts a
    document's epochs from 0; each epoch has an order of its own. Documents without words weigh nothing and stay out; rows
    without doc_id take part by their text. Repeated rows take part each. `place` is the position within the block. Texts
    of any length count whole; other columns are not looked at; an empty table gives no rows.
    """
    return schedule(docs, entropy_share, repetitions, budget, block_tokens).drop("name")


def mixed(docs: DataFrame) -> DataFrame:
    """`docs` in the mixture: each row as often as it occurs there, columns as they are; rows without words stay out.

    The schedule's order is not kept, as a table has none. Rows that share a doc_id are repeated alike, as are rows without
    one that share their text. Texts go along whole whatever their length; an empty table stays empty.
    """
    own = F.coalesce(F.concat(F.lit("#"), F.col("doc_id").cast("string")), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))))
    name = F.when(F.col("doc_id").isNull(), F.col("name")).otherwise(F.concat(F.lit("#"), F.col("doc_id").cast("string")))
    times = schedule(docs).groupBy(name.alias("__id")).agg(F.count("*").alias("n"), F.countDistinct("copy").alias("c"))
    right = small_or_not(cut(times.select("__id", F.least("n", "c").cast("int").alias("__n"))), 500_000)
    found = docs.select(F.struct("*").alias("__row"), own.alias("__id")).join(right, "__id")
    return found.select("__row", F.explode(F.sequence(F.lit(1), "__n"))).select("__row.*")


def op2(docs: DataFrame) -> DataFrame:
    return mix(docs)


def oracle() -> str:
    """`op2` in DuckDB."""
    entropy = lambda a: f"(SELECT ln(sum(pow(p, {a}))) - sum(pow(p, {a}) * ln(p) * {a}) / sum(pow(p, {a})) FROM shares)"
    most = lambda a: f"(SELECT max(pow(p, {a} - 1.0)) / sum(pow(p, {a})) FROM shares)"
    name = "coalesce(doc_id::VARCHAR, name)"
    return f"""
WITH RECURSIVE
docs AS (SELECT * FROM (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) ELSE '' END AS name FROM documents) WHERE tokens > 0),
sources AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS documents FROM docs GROUP BY source),
known AS (SELECT sum(tokens)::BIGINT AS total, count(*) AS n, {ENTROPY_SHARE} * ln(count(*)) AS target FROM sources),
shares AS (SELECT tokens / (SELECT total FROM known) AS p FROM sources),
bisect AS (SELECT 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
  SELECT k + 1, CASE WHEN h >= (SELECT target FROM known) THEN mid ELSE low END, CASE WHEN h >= (SELECT target FROM known) THEN high ELSE mid END
  FROM (SELECT k, low, high, (low + high) / 2 AS mid, {entropy("(low + high) / 2")} AS h FROM bisect WHERE k < {LEVELS * PASSES})),
limits AS (SELECT 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
  SELECT k + 1, CASE WHEN m <= {REPETITIONS} THEN low ELSE mid END, CASE WHEN m <= {REPETITIONS} THEN mid ELSE high END
  FROM (SELECT k, low, high, (low + high) / 2 AS mid, {most("(low + high) / 2")} AS m FROM limits WHERE k < {LEVELS * PASSES})),
first AS (SELECT CASE WHEN n < 2 OR {entropy("1.0::DOUBLE")} >= target THEN 1.0 ELSE (SELECT low FROM bisect WHERE k = {LEVELS * PASSES}) END::DOUBLE AS a FROM known),
chosen AS (SELECT CASE WHEN {most("a")} <= {REPETITIONS} THEN a WHEN {most("1.0::DOUBLE")} <= {REPETITIONS} THEN greatest(a, (SELECT high FROM limits WHERE k = {LEVELS * PASSES})) ELSE 1.0 END AS a FROM first),
weighed AS (SELECT source, tokens, round(pow(tokens::DOUBLE, a) / sum(pow(tokens::DOUBLE, a)) OVER (), 9) AS weight FROM sources, chosen),
plan AS (SELECT source, tokens AS source_tokens, floor(weight * total::DOUBLE)::BIGINT AS quota, floor(weight * total::DOUBLE)::BIGINT // tokens AS epochs, total, greatest(1, (total + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS}) AS n_blocks FROM weighed, known),
keyed AS (SELECT *, md5('{SEED}:' || copy || ':' || {name}) AS key FROM (SELECT *, unnest(range(epochs + 1)) AS copy FROM docs JOIN plan USING (source))),
queued AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, tokens) AS n FROM keyed WHERE copy = epochs),
fitted AS (
  SELECT source, n, tokens <= rest AS taken, rest - CASE WHEN tokens <= rest THEN tokens ELSE 0 END AS rest FROM (SELECT source, n, tokens, quota - epochs * source_tokens AS rest FROM queued WHERE n = 1)
  UNION ALL
  SELECT q.source, q.n, q.tokens <= f.rest, f.rest - CASE WHEN q.tokens <= f.rest THEN q.tokens ELSE 0 END FROM fitted f JOIN queued q ON q.source = f.source AND q.n = f.n + 1),
chosen_copies AS (SELECT * FROM keyed WHERE copy < epochs UNION ALL SELECT queued.* EXCLUDE (n) FROM queued JOIN fitted USING (source, n) WHERE taken),
copies AS (SELECT *, sum(tokens) OVER (PARTITION BY source, copy ORDER BY key, doc_id NULLS FIRST, tokens ROWS UNBOUNDED PRECEDING)::BIGINT - tokens AS before FROM chosen_copies),
blocked AS (SELECT *, least(floor((copy * source_tokens + before) * n_blocks / quota), n_blocks - 1)::BIGINT AS block FROM copies)
SELECT doc_id, source, tokens, copy, block,
  row_number() OVER (PARTITION BY block ORDER BY md5('{SEED}:' || block || ':' || copy || ':' || {name}), doc_id NULLS FIRST, tokens, copy) - 1 AS place
FROM blocked
"""
