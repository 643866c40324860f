"""Byte-level BPE: recursive DuckDB queries inside each Spark partition contract words, ordered aggregation decodes.

Spark deals out the documents; each Python worker holds one in-memory DuckDB with the rank file's merge table. Texts are
cut into units (a word with the space before it, or white space), units into words by the tokenizer's pattern, and the
words not met before go through one recursive query: each step lays a word's tokens out by position, joins neighbouring
pairs with the merge table, contracts the leftmost pair of least rank, and ends when no pair is in the table; of a word
only the latest tokens are held. A word that is a token itself is taken whole, as the library does.

The steps of a word grow with the square of its length, so a longer one goes through the query in overlapping pieces.
Two pieces are joined at a token that both have in the same place. That is exact: no merge crosses the border between
two neighbouring tokens of an encoding, whatever lies around them, and a row of tokens of which each two neighbours stand
side by side in some encoding is the encoding of the whole, as the first merge across a border would have crossed it
there too. Where pieces share no token, the word is cut anew with longer ones.

What is remembered between batches is bounded by number and size, and dropped when full; a text of any length is worked
off in chunks of its units. Decoding joins the ids with the vocabulary and aggregates the pieces in order of position.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes of words in one query; bytes of text handled together; ids decoded by one query.
QUERY_BYTES, BATCH, IDS = 1 << 18, 2 << 20, 1 << 18
#: Units that a worker remembers, and characters of them; units of a long text worked off together.
UNITS, UNIT_CHARACTERS, CHUNK = 200_000, 4 << 20, 50_000
#: A longer unit (in characters) is cut into words at once and not remembered whole.
LONG_UNIT = 256
#: A longer word (in bytes) is encoded in pieces of this length, each beginning half a piece after the one before.
PIECE = 64
#: Pieces of a long word joined together.
SECTION = 4096
#: White space as the tokenizer's pattern has it: Unicode's White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

ENCODE = """
WITH RECURSIVE step(word, tokens) USING KEY (word) AS (
    SELECT word, tokens FROM words
  UNION ALL
    SELECT s.word, list_concat(list_append(s.tokens[:(best & 1048575) - 1], (best >> 20)::INTEGER), s.tokens[(best & 1048575) + 2:])
    FROM step s JOIN (
        SELECT p.word, min((m.token::BIGINT << 20) | p.pos) AS best
        FROM (SELECT word, pos, (tokens[pos]::BIGINT << 20) | tokens[pos + 1] AS pair
              FROM (SELECT word, tokens, unnest(range(1, len(tokens))) AS pos FROM step)) p
        JOIN merges m ON m.pair = p.pair GROUP BY p.word) b ON b.word = s.word)
SELECT word, tokens FROM step ORDER BY word"""

DECODE = """
SELECT i.doc, string_agg(v.piece, '' ORDER BY i.pos) AS text FROM ids i JOIN vocab v ON v.token = i.token
GROUP BY i.doc ORDER BY i.doc"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Numbering(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, name: str) -> int:
        number = self[name] = len(self.names)
        self.names.append(name)
        return number


class Runs:
    """Runs of numbers, one after another in one array."""

    def __init__(self):
        self.starts, self.lengths, self.values = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def add(self, lengths: np.ndarray, values: np.ndarray) -> None:
        begin = len(self.values)
        self.starts = np.concatenate((self.starts, begin + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.values = np.concatenate((self.values, values.astype(np.uint32)))

    def joined(self, which: np.ndarray) -> np.ndarray:
        """The values of the runs `which`, in that order."""
        n = self.lengths[which]
        return self.values[np.repeat(self.starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class Codec:
    """One worker's DuckDB with a vocabulary, and the units and words it has met with their ids.

    A unit is a string, a word is bytes; the words of a long unit stand among the units.
    """

    kept: dict[str, Codec] = {}

    def __init__(self, vocabulary: str, pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern.replace(r"\s\p", WHITE + r"\p").replace(r"\s+", f"[{WHITE}]+").replace(r"\S", f"[^{WHITE}]"))
        self.unit_pattern = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.length_of = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.length_of[list(self.ranks.values())] = list(map(len, self.ranks))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = ((self.ranks[t[:i]] << 20 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        pairs = np.fromiter(merges, dtype=[("pair", np.int64), ("token", np.int32)])
        self.load("merges", pair=pa.array(pairs["pair"]), token=pa.array(pairs["token"]))
        self.load("vocab", token=pa.array(list(self.ranks.values()), pa.int32()), piece=pa.array([t.hex() for t in self.ranks]))
        self.forget()

    @classmethod
    def get(cls, vocabulary: str, pattern: str) -> Codec:
        key = f"{vocabulary}\n{pattern}"
        if key not in cls.kept:
            cls.kept[key] = cls(vocabulary, pattern)
        return cls.kept[key]

    def load(self, name: str, **columns) -> None:
        import pyarrow as pa

        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def forget(self) -> None:
        self.unit, self.word = Numbering(), Numbering()
        self.unit_ids, self.word_ids = Runs(), Runs()
        self.characters = 0

    def full(self) -> bool:
        return self.characters > UNIT_CHARACTERS or max(len(self.unit.names), len(self.word.names)) > UNITS

    def units_of(self, text: str) -> Iterator[list[str | bytes]]:
        """The text's units, a chunk at a time; those that are long are given as their words."""
        found = (m[0] for m in self.unit_pattern.finditer(text))
        chunks = iter(lambda: list(islice(found, CHUNK)), []) if len(text) > BATCH else [self.unit_pattern.findall(text)]
        for units in chunks:
            if max(map(len, units), default=0) <= LONG_UNIT:
                yield units
                continue
            short: list[str | bytes] = []
            for u in units:
                if len(u) <= LONG_UNIT:
                    short.append(u)
                    continue
                words = (m[0].encode("utf-8", "surrogatepass") for m in self.pattern.finditer(u))
                while part := list(islice(words, CHUNK)):
                    short += part
                    if len(short) > CHUNK:
                        yield short
                        short = []
            if short:
                yield short

    def words_of(self, unit: str | bytes) -> list[bytes]:
        """The unit cut by the pattern; the common cases, letters and letters with a mark behind, without it."""
        if isinstance(unit, bytes):
            return [unit]
        letters = unit[1:] if unit[0] == " " else unit
        if letters.isalpha():
            return [unit.encode()]
        if letters[-1:] in ".,!" and letters[:-1].isalpha():
            return [unit[:-1].encode(), unit[-1].encode()]
        return [w.encode("utf-8", "surrogatepass") for w in self.pattern.findall(unit)]

    def learn(self) -> None:
        """Encode the units that have been numbered since the last time."""
        units = self.unit.names[len(self.unit_ids.lengths) :]
        self.characters += sum(map(len, units))
        cut = [self.words_of(u) for u in units]
        words = np.fromiter((self.word[w] for ws in cut for w in ws), np.int64)
        self.learn_words(self.word.names[len(self.word_ids.lengths) :])
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        total = np.concatenate(([0], np.cumsum(self.word_ids.lengths[words])))[ends]
        self.unit_ids.add(np.diff(total, prepend=0), self.word_ids.joined(words))

    def learn_words(self, words: list[bytes]) -> None:
        known = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        lengths = np.ones(len(words), np.int64)
        encoded = []
        for which, contract in ((np.flatnonzero((known < 0) & (size <= PIECE)), self.contract_all), (np.flatnonzero((known < 0) & (size > PIECE)), self.contract_long)):
            n, ids = contract([words[i] for i in which])
            lengths[which] = n
            encoded.append((which, n, ids))
        starts = np.cumsum(lengths) - lengths
        values = np.zeros(lengths.sum(), np.int64)
        values[starts[known >= 0]] = known[known >= 0]
        for which, n, ids in encoded:
            values[np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        self.word_ids.add(lengths, values)

    def contract_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tokens of each word, and all the tokens; one query for QUERY_BYTES of words."""
        import pyarrow as pa

        size = np.fromiter(map(len, words), np.int64, len(words))
        query = (np.cumsum(size) - size) // QUERY_BYTES
        lengths, values = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for at in np.flatnonzero(np.diff(query, prepend=-1)):
            part = words[at : np.searchsorted(query, query[at], "right")]
            ends = np.cumsum([0, *map(len, part)])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.byte[np.frombuffer(b"".join(part), np.uint8)]))
            self.load("words", word=pa.array(np.arange(len(part), dtype=np.int32)), tokens=tokens)
            found = self.db.sql(ENCODE).to_arrow_table()["tokens"].combine_chunks()
            lengths.append(found.value_lengths().to_numpy().astype(np.int64))
            values.append(found.flatten().to_numpy())
        return np.concatenate(lengths), np.concatenate(values)

    def contract_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """`contract_all` for long words, from their pieces. These grow by half of PIECE till each two neighbours share a token.

        Where a run of equal merges makes the tokens depend on where a piece begins, as in a text that repeats itself,
        they agree as soon as half a piece is a multiple of a token's period.
        """
        lengths, parts = np.zeros(len(words), np.int64), [np.empty(0, np.int64)] * len(words)
        left, size = np.arange(len(words)), PIECE
        while len(left):
            n, ids = self.joined_pieces([words[i] for i in left], size)
            for i, part in zip(left[n > 0], np.split(ids, np.cumsum(n[n > 0]))[:-1], strict=True):
                lengths[i], parts[i] = len(part), part
            left, size = left[n == 0], size + PIECE // 2
        return lengths, np.concatenate([np.empty(0, np.int64), *parts])

    def joined_pieces(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tokens and the tokens; none of a word whose pieces can't all be joined."""
        step = size // 2
        count = np.array([max(1, -(-(len(w) - step) // step)) for w in words])
        word = np.repeat(np.arange(len(words)), count)
        start = (np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)) * step
        broken, owners, found, low = np.zeros(len(words), bool), [], [], 0
        for at in range(0, max(1, len(word) - 1), SECTION):  # a section ends with the piece that the next one begins with
            upto = min(at + SECTION + 1, len(word))
            n, ids = self.contract_all([words[w][s : s + size] for w, s in zip(word[at:upto], start[at:upto], strict=True)])
            piece = np.repeat(np.arange(upto - at), n)
            length = self.length_of[ids]
            place = np.cumsum(length) - length
            place += np.repeat(start[at:upto] - place[np.cumsum(n) - n], n)
            token = place << 20 | ids  # the same text in the same place
            _, common, _ = np.intersect1d((piece << 50) + token, ((piece - 1) << 50) + token, return_indices=True)
            joint = np.full(upto - at, -1)
            joint[piece[common][::-1]] = place[common][::-1]
            next_is_same = np.append(word[at + 1 : upto] == word[at : upto - 1], False)
            if upto < len(word):
                next_is_same[-1] = word[upto] == word[upto - 1]
            broken[word[at:upto][:-1][next_is_same[:-1] & (joint[:-1] < 0)]] = True
            begins = np.concatenate(([low], np.where(next_is_same[:-1], joint[:-1], 0)))
            ends = np.where(next_is_same, joint, 1 << 62)
            own = (place >= begins[piece]) & (place < ends[piece])
            if upto < len(word):
                own &= piece < upto - at - 1
                low = int(begins[-1])
            owners.append(word[at:upto][piece[own]])
            found.append(ids[own])
        owner, ids = np.concatenate(owners), np.concatenate(found)
        whole = ~broken[owner]
        return np.bincount(owner[whole], minlength=len(words)), ids[whole]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            self.learn()
            for i, units in held:
                out[i].append(self.unit_ids.joined(units).astype("<u4"))
            held.clear()
            if self.full():
                self.forget()

        waiting = 0
        for i, text in enumerate(texts):
            for units in self.units_of(text or ""):
                held.append((i, np.fromiter(map(self.unit.__getitem__, units), np.int64, len(units))))
                waiting += len(units)
                if waiting > 8 * CHUNK or len(text or "") > BATCH:
                    flush()
                    waiting = 0
        flush()
        return [np.concatenate(x) if x else np.empty(0, "<u4") for x in out]

    def pieces(self, ids: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """(which, its next bytes) in order; of all ids IDS at a time are decoded by a query."""
        import pyarrow as pa

        parts = [(i, x[k : k + IDS]) for i, x in enumerate(ids) for k in range(0, len(x), IDS)]
        sizes = np.cumsum([len(x) for _, x in parts])
        at = 0
        while at < len(parts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + IDS, "right")))
            here = parts[at:upto]
            n = [len(x) for _, x in here]
            flat = np.concatenate([x for _, x in here]).astype(np.int32)
            self.load("ids", doc=pa.array(np.repeat(np.arange(len(here), dtype=np.int32), n)), pos=pa.array(np.arange(len(flat), dtype=np.int32)), token=pa.array(flat))
            for (i, _), piece in zip(here, self.db.sql(DECODE).to_arrow_table()["text"].to_pylist(), strict=True):
                yield i, bytes.fromhex(piece)
            at = upto

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in ids]
        for i, piece in self.pieces(ids):
            out[i].append(piece)
        return [b"".join(x) for x in out]


def parameters(vocabulary: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return vocabulary or default_vocabulary(), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` (doc_id, text) -> (doc_id, token_ids array<int>). Null or empty text: no ids. One row for each row.

    Repeated rows are encoded alike, other columns left out; a text of any length is worked off in chunks, its ids are one
    cell. An empty table gives an empty result.
    """
    import pyarrow as pa

    at = parameters(vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(*at)
        for batch in slices(batches, "text", BATCH):
            texts = [None if t is None else t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            ids = [x.astype(np.int32) for x in codec.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>")


def decode(tokens: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, token_ids) -> (doc_id, decoded binary). Null or no ids: no bytes.

    Row for row, repeated ones too; long lists are decoded IDS at a time; an empty table gives an empty result.
    """
    import pyarrow as pa

    at = parameters(vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(*at)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [np.array(x or [], dtype=np.int32) for x in part.column("token_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(codec.decode(ids), pa.binary())], ["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long"), "token_ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, for every row of `docs`.

    Null text counts as empty; repeated rows and ties are encoded alike; other columns are not looked at, whatever their
    names. An empty table gives an empty result. A very long text takes its own length in memory a few times, no more.
    """
    import pyarrow as pa

    at = parameters(vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(*at)
        for batch in slices(batches, "text", BATCH):
            texts = [None if t is None else t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            ids = codec.encode(texts)
            back = [hashlib.sha256() for _ in texts]
            del texts
            for i, piece in codec.pieces(ids):
                back[i].update(piece)
            columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64())]
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([x.hexdigest() for x in back])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9(docs: DataFrame) -> DataFrame:
    return round_trip(docs)
