"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from seqscan.llm import bpe


def library():
    with open(bpe.default_vocabulary(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(1)
    alphabet = "abcdefgh etaoinshrdlu  \n\t'´éñßüÉÑ.,!?0123456789²½Ⅷ\x1c\x1f\x85\xa0 漢字😀<|endoftext|>_-=\r\x0b"
    made = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(300)]
    return [None, "", " ", "\n\n  x", "it's we'll 'S don't  \n ok ", "a" * 3000, "ab" * 700, "!" * 900, "<|endoftext|>", "a\x1cb \x1c c", *made, "word " * 20000]


def test_same_as_library(spark):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS token_ids", "'x' AS n_tokens")
    lib = library()
    want = []
    for i, t in rows:
        ids = np.array(lib.encode_ordinary(t or ""), dtype="<u4")
        want.append((str(i), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op9(docs).collect()]
    assert sorted(got) == sorted(want)


def test_encode_then_decode(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts())}
    assert bpe.op9(docs.limit(0)).collect() == []


def test_forgetting_changes_nothing(monkeypatch):
    lib, codec = library(), bpe.Codec(bpe.default_vocabulary(), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "UNITS", 50)
    for t in texts()[:40]:
        assert codec.encode([t])[0].tolist() == lib.encode_ordinary(t or "")


def test_long_words_are_joined_from_pieces(monkeypatch):
    r = random.Random(7)
    lib, codec = library(), bpe.Codec(bpe.default_vocabulary(), public_tokenizers.PATTERN)
    say = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    cjk = [chr(c) for c in range(0x4E00, 0x9000)]
    long = [say("abcdefghijklmnopqrstuvwxyz", 500) for _ in range(200)] + [say("aab", 4000), say("aaaaabehst", 20_000), say(cjk, 30_000), "。".join(say(cjk, 100) for _ in range(300)), "😀" * 900, "=" * 70_001, "\n" * 500 + " " * 3000 + "x"]
    long += [p * 700 for p in ("a", "ab", "abc", "hahah", "-=-", "lol", "abcdefg", "é", "na")]
    assert [x.tolist() for x in codec.encode(long)] == [lib.encode_ordinary(t) for t in long]
    monkeypatch.setattr(bpe, "SECTION", 3)
    some = [*long[:3], long[200], long[203], long[204][:500]]
    assert [x.tolist() for x in codec.encode([" ".join(some)])] == [lib.encode_ordinary(" ".join(some))]


def test_very_long_texts_in_bounded_memory(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(9000)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(1_100_000)), "y" * 300_000, " ".join(f"{r.randrange(10**12):x}" for _ in range(60_000))]
    codec = bpe.Codec(bpe.default_vocabulary(), public_tokenizers.PATTERN)
    lib = library()
    for text in texts:
        (ids,) = codec.encode([text])
        assert ids.tolist() == lib.encode_ordinary(text) and codec.decode([ids]) == [text.encode()]
        assert len(codec.unit.names) <= bpe.UNITS + 9 * bpe.CHUNK
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[2])], "doc_id long, text string")
    got = {x.doc_id: (x.n_tokens, x.decoded_sha256) for x in bpe.op9(docs).collect()}
    assert got == {i: (len(lib.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in ((1, texts[0]), (2, texts[2]))}
