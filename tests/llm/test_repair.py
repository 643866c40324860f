"""Conversation repair, against a plain version that tries edits row by row."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from seqscan.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, at long, digest string"
SPACE = " \t\n\v\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain_order(r):
    conv, turn, role, text = r
    said = f"{' ' if conv is None else conv}:{len(role.encode())}:{role}{text}"
    return turn is not None, turn or 0, role, hashlib.md5(said.encode()).digest()


def plain_repair(rows):
    """(cost, audit, repaired lines): the least of all ways to each number of rows and state, kept as strings."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    ways = {"": (0, "", ())}

    def insert(ways):
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                turn = "assistant" if state == "u" else "user"
                new = (cost + 5, audit + "I", (*lines, f"{turn}:"))
                ways[turn[0]] = min(ways.get(turn[0], new), new)
        return ways

    for (_, _, role, text), fault in zip(rows, faults):
        after: dict = {}

        def offer(state, way):
            after[state] = min(after.get(state, way), way)

        for state, (cost, audit, lines) in insert(ways).items():
            offer(state, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in step[state]:
                    offer(role[0], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in step[state]:
                        offer(new[0], (cost + 1 + more, audit + "R", (*lines, f"{new}:{text}")))
        ways = after
    ends = insert(ways)
    cost, audit, lines = min(ends[s] for s in ("", "a") if s in ends)
    return Counter(faults), cost, audit, "\n".join(lines)


def plain(rows):
    by = defaultdict(list)
    for r in plain_damage(rows):
        by[r[0]].append(r)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=plain_order)
        n, cost, audit, text = plain_repair(own)
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, convs=60):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.choice([1, 2, 3, 8, 30])):
            text = r.choice(["Yes.", "No!", "", " \n", "cut off", "Why?", f"Turn {t}.", f"open {t}", "é. \t", None])
            rows.append((r.choice([c, c, c, c, None if c == 7 else c]), r.choice([t, t, t, t + 3, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "amy", None]), text))
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(x) for x in repair.op13(df, **more).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_plain_version(spark, seed):
    rows = conversations(seed)
    assert run(spark, rows + rows[:9]) == plain(rows + rows[:9])


@pytest.mark.parametrize("chunk", [1, 3, 7])
def test_long_conversations_pass_from_chunk_to_chunk(spark, chunk):
    r = random.Random(chunk)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice([f"Turn {t}.", f"open {t}", "Yes."])) for t in range(300)]
    rows += [(2, None, "user", "Same.")] * 40 + conversations(3, 12)
    assert run(spark, rows, chunk=chunk) == plain(rows)


def test_costs_of_single_faults():
    row = lambda role, text="Fine.": (0, 0, role, text)
    assert plain_repair([row("user"), row("assistant", "Well.")])[1:3] == (0, "KK")
    assert plain_repair([row("system"), row("user"), row("assistant", "cut")])[1:3] == (4, "RRD")
    assert plain_repair([row("system")])[1:3] == (2, "D")
    assert plain_repair([row("user"), row("user", "More.")])[1:3] == (1, "KR")


def test_empty_table_and_lost_conversations(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(lost, 0, "user", "Hello.")]) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert run(spark, []) == []


def test_very_long_text(spark):
    rows = [(5, 1, "user", "word " * 600_000 + "end."), (5, 2, "assistant", "Yes.")]
    assert run(spark, rows) == plain(rows)


def test_repaired_lines(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 1), (1, 1, "user", "And?", 1), (1, 2, "assistant", "", 1)], "conv long, turn long, role string, text string, n int")
    _, lines = repair.repair(rows)
    assert [(x.role, x.text) for x in lines.orderBy("at", "place").collect()] == [("user", "Hi."), ("assistant", "And?")]


def test_equals_sql(spark, sf_dir):
    got = repair.op13(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{sf_dir}/conversations.parquet'")
    want = con.sql(repair.ORACLE)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
