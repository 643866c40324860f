"""SimHash groups and duplicate passages against plain versions over all pairs and windows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqscan.llm import simhash, substring

SCHEMA = "doc_id long, text string, fp string, key int, words string"


def fixture_rows(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Über", "ñ", "!!"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = [say(r.randint(1, 120)) for _ in range(60)]
    texts = base + [b.upper() for b in base[:5]] + base[:10] + [None, "", "  \n", "a", "a b"]
    for b in base[:20]:
        words = b.split()
        words[len(words) // 2] = "changed"
        texts.append("\n".join(words))
    passage = say(60)
    texts += [say(9) + " " + passage + "\t" + say(11) for _ in range(8)] + [passage[: len(passage) // 2] + " " + say(40)] + [say(30) + " " + " ".join(passage.split()[40:]) + " " + " ".join(base[0].split()[:15])]
    texts.append(say(20000))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return [(i * 7 - 40, t, "x", 1, "y") for i, t in zip(ids, texts)]


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted((str(r[0]), f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, group))


@pytest.mark.parametrize("shard", [simhash.SHARD, 2])
def test_simhash_groups_equal_all_pairs(spark, shard):
    rows = fixture_rows() + [(5, "a b", "z", 0, "q"), (None, "a", "x", 1, "y"), (None, "never seen " * 9, "x", 1, "y")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), shard=shard).collect()
    assert sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got) == plain_groups(rows)


def test_shards_link_within_radius_only():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40).astype(np.uint64)
    flips = np.array([1 << k for k in range(64)], dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ np.bitwise_xor.reduce(r.choice(flips, (40, n)), axis=1) for n in (1, 2, 3, 4)]]))
    shard = np.zeros(len(fp), np.int64)
    label = simhash.linked_in_shards(shard, fp, np.ones(len(fp), bool), chunk=7)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    for _ in range(8):
        near = near @ near
    assert (label == near.argmax(axis=1)).all()


@pytest.mark.parametrize("shard", [simhash.SHARD, 16])
def test_parts_of_hot_shards_lose_no_link(spark, shard):
    """Fingerprints that all agree in a 28-bit shard: its parts hold few each, and every near pair meets in one."""
    r = np.random.default_rng(8)
    common, rest = 0x5A5A << 48 | 0xABC << 36, (1 << 36) - 1
    base = [int(x) & rest for x in r.integers(0, 1 << 62, 300)]
    near = [x ^ sum(1 << int(b) for b in r.choice(36, n, replace=False)) for n in (1, 2, 3, 4) for x in base[:60]]
    fps = sorted({common | x for x in base + near})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    keyed = spark.createDataFrame(signed, "fp long").select("fp", F.inline(simhash.shard_keys(F.col("fp"))))
    hot, n_hot = simhash.hot_keys(keyed, shard)
    assert n_hot == (0 if shard == simhash.SHARD else n_hot) and (shard == simhash.SHARD or n_hot > 0)
    parts = keyed.join(hot, "key").select("fp", F.explode(simhash.part_keys(F.col("key"), F.col("rest"))).alias("key"))
    held = {}
    for x in (parts if n_hot else keyed).collect():
        held.setdefault(x.key, set()).add(x.fp & (1 << 64) - 1)
    met = {(a, b) for group in held.values() for a in group for b in group if a < b and (a ^ b).bit_count() <= 3}
    assert met == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3} and len(met) > 150
    if n_hot:
        assert max(map(len, held.values())) < len(fps) / 4


def test_keep_first_keeps_one_of_each_group(spark):
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g for _, _, g in plain_groups(rows)})
    odd = spark.createDataFrame([*rows, rows[0], (None, "solitary", "", 0, ""), (None, "solitary", "", 0, "")], SCHEMA)
    assert simhash.keep_first(odd).count() == kept.count() + 1


def test_one_id_of_unrelated_texts(spark):
    r = random.Random(9)
    one, other, third = (" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    rows = [(5, one), (5, other), (5, other), (6, other.upper()), (7, one), (7, third), (8, third), (4, "alone")]
    kept = simhash.keep_first(spark.createDataFrame([(i, t, "", 0, "") for i, t in rows], SCHEMA).repartition(3)).collect()
    assert sorted((x.doc_id, x.text) for x in kept) == sorted([(4, "alone"), (5, one), (5, other), (7, third)])


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert simhash.keep_first(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_substrings(rows, window=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = []
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("blocks", [1, 7])
def test_substrings_equal_every_window(spark, blocks):
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = substring.without_spans(docs, substring.duplicate_spans(docs, blocks=blocks))
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got.collect())
    assert got == plain_substrings(rows)
    assert sum(r[2] for r in got) > 500


def test_substrings_of_odd_tables(spark):
    assert substring.op8(spark.createDataFrame([], SCHEMA)).collect() == []
    text = " ".join(f"t{i}" for i in range(20))
    rows = [(None, text, "", 0, ""), (1, text, "", 0, ""), (1, text, "", 0, ""), (2, text + " " + text, "", 0, ""), (3, None, "", 0, "")]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring.op8(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 20, 0), ("1", 20, 0), ("2", 40, 40), ("3", 0, 0), ("None", 20, 0)]


def test_parse_goes_on_across_references():
    starts = np.array([3, 4, 5, 6, 20, 21])
    owners = np.array([1, 1, 2, 2, 1, 1])
    places = np.array([7, 8, 0, 1, 30, 2])
    factors = substring.parse(starts, owners, places)
    assert factors == [(3, 17, 1, 7), (5, 19, 2, 0), (20, 33, 1, 30), (21, 34, 1, 2)]
    assert substring.covered(34, factors).sum() == 16 + 14


@pytest.mark.parametrize("repeated", [False, True])
def test_factors_stand_in_their_references(spark, repeated):
    rows = fixture_rows(5)
    if repeated:  # some ids with several texts
        rows += [(rows[k][0], rows[k + 1][1], "x", 1, "y") for k in range(0, 60, 6)]
    words = {}
    for i, t, *_ in rows:
        words.setdefault(i, []).append((t or "").split())
    found = substring.duplicate_spans(spark.createDataFrame(rows, SCHEMA).repartition(4), blocks=5).collect()
    n = 0
    for x in found:
        for f in x.spans:
            said = [w[f.place : f.place + f.end - f.start] for w in words[f.reference]]
            assert f.reference < x.doc_id and f.end - f.start >= 13
            assert any(w[f.start : f.end] == y for w in words[x.doc_id] for y in said if len(y) == f.end - f.start)
            n += 1
    assert n > 30


def test_rows_of_one_id_lose_only_their_own_words(spark):
    r = random.Random(14)
    a, x, b = (" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    rows = [(1, a), (5, f"{x} {a}"), (5, f"{b} {b}"), (5, f"{b} {b}"), (7, b)]
    got = substring.op8(spark.createDataFrame([(i, t, "", 0, "") for i, t in rows], SCHEMA).repartition(3)).collect()
    assert sorted((y.doc_id, y.n_words, y.n_removed) for y in got) == [(1, 40, 0), (5, 80, 0), (5, 80, 0), (5, 80, 40), (7, 40, 40)]


def test_one_window_in_very_many_documents(spark):
    line = " ".join(f"c{k}" for k in range(14))
    rows = [(i, f"{line} own{i}", "", 0, "") for i in range(20_000)]
    got = substring.op8(spark.createDataFrame(rows, SCHEMA)).groupBy("n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(0, 1), (14, 19_999)]


def test_gaps_round_trip():
    gaps = np.array([0, 254, 255, 256, 70000, 3])
    assert (substring.unpack_gaps(substring.pack_gaps(gaps), 6) == gaps).all()
