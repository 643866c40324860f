"""Phrase collocation mining over vertical positional inverted lists.

Documents are packed into blocks of one language, about BLOCK bytes of text each. In a block a word or phrase has the list
of the positions where it begins, numbers that skip one at the end of a piece of text. A phrase of k words is extended by
merge-joining its list, moved k places on, with the postings of the words there; the lengths of the new lists, summed over
all blocks, are the exact frequencies. Only phrases that are frequent over all blocks are extended further, and only where
the k words that follow the first are frequent too.

What is frequent must be known to every block. Up to MOST_TOLD phrases of a length are told to all tasks; more are joined
with what each block asks for, and the answers with the blocks, by the same steps. Between lengths the blocks are written
to the folder that all executors share, where a lost executor's work can be read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqscan.sources.folders import shared_folder

from .common import cut, slices

#: Least frequency of a phrase, most words of one, and rows of a language in the report.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text of a block, about; of all blocks that a task fills at the same time.
BLOCK, FILLING = 1 << 20, 8 << 20
#: Frequent words or phrases that all tasks are told at most, and bytes of words.
MOST_TOLD, MOST_BYTES = 2_000_000, 32 << 20
#: Pairs that a task holds before it merges them, about; blocks to a bucket of pairs.
PAIRS, BUCKET_BLOCKS = 2_000_000, 4
#: By byte: 0 in a word, 1 between words, 2 between pieces.
KINDS = np.zeros(256, np.uint8)
KINDS[list(b" \t")] = 1
KINDS[list(b".,;:!?\n\v\f\r")] = 2
STATE = "block long, at binary, which binary, ids binary, word_at binary, word_which binary, word_ids binary"
ASKED = "block long, number int, parent long, word long"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers compressed, as blocks lie in memory in all steps between the ones that unpack them."""
    data = np.ascontiguousarray(numbers).tobytes()
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind)


def places(numbers: np.ndarray) -> bytes:
    """Ascending positions as differences, which compress well."""
    return packed(np.diff(numbers, prepend=0).astype(np.int32))


def from_places(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.int32), dtype=np.int64)


def words_of_text(data: bytes) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Positions of the words of lower-cased text, and the words."""
    letters = np.frombuffer(data, np.uint8)
    kinds = KINDS[letters]
    edges = np.diff((kinds == 0).view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    pieces = np.cumsum(kinds == 2, dtype=np.int32)
    apart = pieces[starts[1:]] > pieces[ends[:-1] - 1] if len(starts) else np.empty(0, bool)
    at = np.arange(len(starts))
    at[1:] += np.cumsum(apart)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters[kinds == 0]))])
    return at, words.dictionary_encode()


def blocks_of(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """`docs` (lang, text) -> (block, lang, size, at, which, words, counts): the words of a block's texts and where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, sizes = TaskContext.get().partitionId() << 32, {}, {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal made
            at, words = words_of_text(b"\n".join(held.pop(lang)).lower())
            sizes.pop(lang)
            made += 1
            which = words.indices.to_numpy(zero_copy_only=False)
            listed = words.dictionary.cast(pa.large_string()).cast(pa.string())
            counts = np.bincount(which, minlength=len(listed))
            columns = [[made], [lang], [len(at)], [places(at)], [packed(which.astype(np.int32))]]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), v) for v in (listed, pa.array(counts, pa.int64()))]
            return pa.RecordBatch.from_arrays([*arrays, *lists], ["block", "lang", "size", "at", "which", "words", "counts"])

        for batch in batches:
            for part in slices(iter([batch]), "text", BLOCK):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    held.setdefault(lang, []).append(text)
                    sizes[lang] = sizes.get(lang, 0) + len(text) + 64
                    if sizes[lang] > block:
                        yield close(lang)
                while sum(sizes.values()) > FILLING:
                    yield close(max(sizes, key=sizes.get))
        for lang in list(held):
            yield close(lang)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "block long, lang string, size long, at binary, which binary, words array<string>, counts array<long>")


def stored(df: DataFrame) -> DataFrame:
    """Written and read again, so that neither a lost executor nor a later step makes it anew."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(counts: DataFrame) -> DataFrame:
    """With a number `gid` for each row, from 0 without gaps: those of a partition after those of the ones before it."""
    placed = cut(counts).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))
    ahead = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("ahead"))
    # A row for each partition, as the driver has one for each task.
    return cut(placed.join(F.broadcast(ahead), "part").withColumn("gid", F.col("ahead") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "ahead"))


class Joined:
    """A block's frequent phrases of k words, and their extensions by a word.

    `at` are the positions in order, `which` the phrase at each by its place in `ids`; likewise the words' postings.
    """

    def __init__(self, k: int, at, which, ids, word_at, word_which, word_ids):
        self.k, self.at, self.which, self.ids = k, at, which, ids
        self.word_at, self.word_which, self.word_ids = word_at, word_which, word_ids
        after = np.searchsorted(word_at, at + k)
        found = self.among(after, word_at, at + k)
        if k > 1:
            found &= self.among(np.searchsorted(at, at + 1), at, at + 1)
        self.begins, words = at[found], word_which[after[found]]
        pairs = which[found].astype(np.int64) * max(1, len(word_ids)) + words
        listed, self.list_of, self.lengths = np.unique(pairs, return_inverse=True, return_counts=True)
        self.parents, self.words = ids[listed // max(1, len(word_ids))], word_ids[listed % max(1, len(word_ids))]

    @staticmethod
    def among(found: np.ndarray, sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return (found < len(sorted_)) & (sorted_[np.minimum(found, len(sorted_) - 1)] == wanted) if len(sorted_) else np.zeros(len(wanted), bool)

    @classmethod
    def read(cls, k: int, row: list[bytes]) -> Joined:
        lists = [f(b) for f, b in zip([from_places, lambda b: unpacked(b, np.int32), lambda b: unpacked(b, np.int64)] * 2, row, strict=True)]
        return cls(k, *(lists[3:] * 2 if k == 1 else lists))

    def advanced(self, gids: np.ndarray) -> list[bytes]:
        """The state at k + 1: extensions with a number, and the postings that may extend them."""
        own = gids[self.list_of]
        begins, own = self.begins[own >= 0], own[own >= 0]
        ids, which = np.unique(own, return_inverse=True)
        used = self.among(np.searchsorted(begins, self.word_at - self.k - 1), begins, self.word_at - self.k - 1)
        left, renamed = np.unique(self.word_which[used], return_inverse=True)
        return [places(begins), packed(which.astype(np.int32)), packed(ids.astype(np.int64)), places(self.word_at[used]), packed(renamed.astype(np.int32)), packed(self.word_ids[left])]


def asked(state: DataFrame, k: int) -> DataFrame:
    """Each block's extensions of its phrases of k words, numbered as in `Joined`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, *row = (c[i].as_py() for c in batch.columns)
                made = Joined.read(k, row)
                n = len(made.lengths)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(made.parents), pa.array(made.words)], [c.split()[0] for c in ASKED.split(", ")])

    return state.mapInArrow(run, ASKED)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order with the sums of their counts."""
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.diff(every, prepend=every[0] - 1)) if len(every) else np.empty(0, np.int64)
    return every[first], np.add.reduceat(n, first) if len(first) else n


class Sums:
    """Counts by key, merged whenever PAIRS of them have come together."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting, self.held = 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > PAIRS + self.held:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = merged(self.keys, self.counts) if self.keys else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.keys, self.counts, self.waiting, self.held = [keys], [counts], len(keys), len(keys)
        return keys, counts


def frequent_pairs(state: DataFrame, k: int, n_words: int, least: int, buckets: int) -> DataFrame:
    """(parent, word, f): the extensions of phrases of k words that stand `least` times or more in all blocks.

    A pair is one number, parent * n_words + word. A task sums up what its blocks have, and hands it on in buckets by hash,
    each a list of numbers in order, by their differences, compressed; a bucket's lists are merged as they come.
    """
    many = max(1, n_words)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()

        def dealt() -> Iterator[pa.RecordBatch]:
            keys, counts = sums.merge()
            drawn = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(drawn, kind="stable")
            keys, counts, drawn = keys[order], counts[order], drawn[order]
            bounds = np.flatnonzero(np.diff(drawn, prepend=-1, append=-1)) if len(drawn) else np.empty(0, np.int64)
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield pa.RecordBatch.from_arrays([pa.array([drawn[a]], pa.int64()), pa.array([packed(np.diff(keys[a:b], prepend=0))]), pa.array([packed(counts[a:b])])], ["bucket", "pairs", "counts"])
            sums.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                made = Joined.read(k, [c[i].as_py() for c in batch.columns[1:]])
                sums.add(made.parents * many + made.words, made.lengths.astype(np.int64))
                if sums.held > PAIRS:
                    yield from dealt()
        yield from dealt()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, Sums()

        def done() -> pa.RecordBatch:
            keys, counts = sums.merge()
            keys, counts = keys[counts >= least], counts[counts >= least]
            return pa.RecordBatch.from_arrays([pa.array(keys // many), pa.array(keys % many), pa.array(counts)], ["parent", "word", "f"])

        for batch in batches:
            for bucket, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if now is not None:
                        yield done()
                    now, sums = bucket, Sums()
                sums.add(np.cumsum(unpacked(pairs, np.int64)), unpacked(counts, np.int64))
        if now is not None:
            yield done()

    lists = state.mapInArrow(told, "bucket long, pairs binary, counts binary")
    return lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(counted, "parent long, word long, f long")


def pair_numbers(parents: np.ndarray, words: np.ndarray, gids: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tells the numbers of pairs (parent, word), -1 where there is none."""
    by_parent, by_word = np.unique(parents), np.unique(words)
    keys = np.searchsorted(by_parent, parents) * max(1, len(by_word)) + np.searchsorted(by_word, words)
    order = np.argsort(keys)
    keys, gids = keys[order], gids[order]

    def tell(p: np.ndarray, w: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(by_parent, p), np.searchsorted(by_word, w)
        known = Joined.among(a, by_parent, p) & Joined.among(b, by_word, w)
        key = np.where(known, a * max(1, len(by_word)) + b, -1)
        at = np.searchsorted(keys, key)
        return np.where(Joined.among(at, keys, key), gids[np.minimum(at, max(0, len(gids) - 1))] if len(gids) else -1, -1)

    return tell


def answered(asks: DataFrame, frequent: DataFrame, on: list[str]) -> DataFrame:
    """(block, answers: the numbers of those of its questions that are frequent)."""
    return asks.join(frequent.select(*on, "gid"), on).groupBy(F.col("block").alias("__block")).agg(F.collect_list(F.struct("number", "gid")).alias("answers"))


def advance(state: DataFrame, k: int, frequent: DataFrame) -> DataFrame:
    """The blocks' states at k + 1, given the frequent (parent, word, gid)."""
    tell = None
    if frequent.count() <= MOST_TOLD:
        told = frequent.select("parent", "word", "gid").toArrow()
        tell = state.sparkSession.sparkContext.broadcast([told.column(c).to_numpy() for c in ("parent", "word", "gid")])
    else:
        state = state.join(answered(asked(state, k), frequent, ["parent", "word"]), F.col("block") == F.col("__block"), "left").drop("__block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pair_numbers(*tell.value) if tell is not None else None
        for batch in batches:
            for i in range(batch.num_rows):
                block, *row = (c[i].as_py() for c in batch.columns[:7])
                made = Joined.read(k, row)
                gids = numbers(made.parents, made.words) if numbers else as_array(batch.column("answers")[i].as_py(), len(made.lengths))
                yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([x], pa.binary()) for x in made.advanced(gids)]], [c.split()[0] for c in STATE.split(", ")])

    return stored(state.mapInArrow(run, STATE))


def as_array(answers: list[dict] | None, n: int) -> np.ndarray:
    gids = np.full(n, -1, np.int64)
    for a in answers or ():
        gids[a["number"]] = a["gid"]
    return gids


def first_state(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """The blocks' postings of frequent words (lang, word, gid); as they are also the phrases of one word, those are left empty."""
    tell = None
    n, size = words.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    if n <= MOST_TOLD and (size or 0) <= MOST_BYTES:
        told: dict[str, dict[str, int]] = {}
        for r in words.select("lang", "word", "gid").collect():
            told.setdefault(r["lang"], {})[r["word"]] = r["gid"]
        tell = blocks.sparkSession.sparkContext.broadcast(told)
        state = blocks.select("block", "lang", "at", "which", "words")
    else:
        asks = blocks.select("block", "lang", F.posexplode("words").alias("number", "word"))
        state = blocks.join(answered(asks, words, ["lang", "word"]), F.col("block") == F.col("__block"), "left").select("block", "lang", "at", "which", "words", "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, lang, at, which, words = (batch.column(c)[i].as_py() for c in ("block", "lang", "at", "which", "words"))
                if tell is not None:
                    own = tell.value.get(lang, {})
                    gids = np.array([own.get(w, -1) for w in words], np.int64)
                else:
                    gids = as_array(batch.column("answers")[i].as_py(), len(words))
                codes = unpacked(which, np.int32)
                found = gids[codes] >= 0 if len(codes) else np.empty(0, bool)
                ids, number = np.unique(gids[codes[found]], return_inverse=True)
                lists = [packed(np.empty(0))] * 3 + [places(from_places(at)[found]), packed(number.astype(np.int32)), packed(ids)]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([x], pa.binary()) for x in lists]], [c.split()[0] for c in STATE.split(", ")])

    return stored(state.mapInArrow(run, STATE))


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """`docs` (lang, text) -> ((lang, n) all words, (lang, phrase, words, f) of the phrases of up to `longest` words and f >= least)."""
    blocks = stored(blocks_of(docs, block))
    totals = blocks.groupBy("lang").agg(F.sum("size").alias("n"))
    counted = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    words = numbered(counted.where(F.col("f") >= least))
    n_words, buckets = words.count(), max(8, -(-blocks.count() // BUCKET_BLOCKS))
    state = first_state(blocks, words)
    known = words.select("gid", "lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f")
    every = [known]
    last = words.select(F.col("gid").alias("word"), F.col("word").alias("letters"))
    for k in range(1, longest):
        frequent = numbered(frequent_pairs(state, k, n_words, least, buckets))
        if frequent.isEmpty():
            break
        named = frequent.join(known.select(F.col("gid").alias("parent"), "lang", "phrase"), "parent").join(last, "word")
        known = cut(named.select("gid", "lang", F.concat_ws(" ", "phrase", "letters").alias("phrase"), F.lit(k + 1).alias("words"), "f"))
        every.append(known)
        if k + 1 < longest:
            state = advance(state, k, frequent)
    found = every[0]
    for more in every[1:]:
        found = found.unionByName(more)
    return totals, found.select("lang", "phrase", "words", "f")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = 100, block: int = BLOCK) -> DataFrame:
    """`docs` (lang, text, ...) -> (lang, phrase, a, l, r, n, score) of the candidates that no longer one stands for.

    A phrase of 2 to `longest` words that stands at least `least` times in its language is a candidate. Cut after its first
    words, its parts stand l and r times; the cut of least score floor(1000 a n / (l r)) counts, of equal ones the first. A
    candidate goes if a longer one that holds its words has at least `share` hundredths of its frequency; those longer by
    one word tell, as a phrase stands nowhere more often than what it holds.

    Null text is empty, null lang `und`. Repeated rows and copies count each time. Texts of any length are taken whole, in a
    block of their own where they are longer than one. Other columns are not looked at. An empty table gives no rows.
    """
    totals, found = frequencies(docs, least, longest, block)
    found = cut(found)
    words = F.split("phrase", " ")
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("times"))
    long = found.where("words > 1").withColumn("list", words)
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), F.col("list"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("list", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("list", F.col("k") + 1, F.size("list")), " ").alias("tail"))
    cuts = cuts.join(parts.withColumnsRenamed({"part": "head", "times": "l"}), ["lang", "head"]).join(parts.withColumnsRenamed({"part": "tail", "times": "r"}), ["lang", "tail"])
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    # 1000 a n has 36 digits at most: counts pass 64 bits when multiplied.
    scored = cuts.join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "lang").withColumn("up", F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n"))).withColumn("down", exact("l") * exact("r"))
    scored = scored.withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    held = found.where("words > 2").withColumn("list", words).select("lang", "f", F.explode(F.array(F.array_join(F.slice("list", 1, F.col("words") - 1), " "), F.array_join(F.slice("list", 2, F.col("words") - 1), " "))).alias("phrase"))
    covered = held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    return left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op11(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """Each language's first `top` collocations: lang, rank, phrase, a, l, r, n, score."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs, least, block=block).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


ORACLE = rf"""
WITH pieces AS (SELECT row_number() OVER () AS piece, lang, words FROM (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)) WHERE len(words) > 0),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM (
  SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(words) >= k)),
found AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS words FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, phrase, words, f AS a, unnest(range(1, k)) AS cut FROM found WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, cut, h.f AS l, t.f AS r, n, (1000::HUGEINT * a * n // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN found h ON h.lang = c.lang AND h.phrase = array_to_string(c.words[1 : cut], ' ') JOIN found t ON t.lang = c.lang AND t.phrase = array_to_string(c.words[cut + 1 :], ' ') JOIN totals ON totals.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, max(f) AS f FROM (SELECT lang, f, words, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM found WHERE k > 2)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN longer USING (lang, phrase) WHERE f IS NULL OR 100 * f < 100 * a
QUALIFY rank <= {TOP}
"""
