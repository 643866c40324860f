"""Conversation structure repair: the cheapest edits that make a conversation alternate, by dynamic programming over turns.

A conversation's rows lie in chunks of turns, in order; a chunk is a string of codes, one for each different row: what its
role begins with and its fault. Chunks of similar length are laid side by side in arrays whose first axis is time, and one
step of the recurrence updates all of them. States say what has been given so far: nothing, a system turn, an open user
turn, a closed pair. Going backwards, every state's cost to the end is stored; going forwards, each step takes the
ASCII-least edit that keeps to that cost.

Nearly every conversation is one chunk. A longer one is passed on from chunk to chunk: each chunk's costs between every two
states are worked out in parallel, the costs to the end then run backwards over these small matrices, and what each chunk
does to a state runs forwards; both need one row a chunk and hold one chunk's numbers. Rows are dealt to chunks by ranges
of (conversation, turn), so that a conversation with a large part of all rows is spread over many tasks; rows that are equal
are one with a count. Only rows that stay carry their text again, to be hashed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Different rows of a chunk at most; states times rows times chunks of one array.
CHUNK, CELLS = 2048, 1 << 22
#: Costs of keeping, changing a role, deleting, inserting, and leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. The first and last may end.
FIRST, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: What a role begins with, and a row's fault; a code is 4 * fault + initial.
INITIALS, FINE, BLANK, DUPLICATE, CUT_OFF = "sua", 0, 1, 2, 3
END = np.array([0, FAR, FAR, 0], np.int64)
CHUNKS = "conv {kind}, at long, codes binary, more binary, digests binary, first_turn long, last_turn long, first_initial string, last_initial string, turns long, illegal long"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted damage by the checksum of `conv_id:turn`; nulls are written as one space."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    rows = conversations.select("conv_id", "turn", written("role").alias("role"), written("text").alias("text"), kind.alias("k")).where("k != 0")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).alias("n"))


def marked(rows: DataFrame) -> DataFrame:
    """Rows without their texts: (conv, turn, role, digest, n equal ones, fault of the first of them)."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\v\f\r")), -1, 1)
    own = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(FINE)
    light = rows.select("conv", "turn", "role", digest(), own.alias("own"), "n")
    equal = light.groupBy("conv", "turn", "role", "digest", "own").agg(F.sum("n").cast("long").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"))
    seen = equal.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    met = equal.join(seen, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return met.select("conv", "turn", "role", "digest", "n", F.when((F.col("own") != BLANK) & again, DUPLICATE).otherwise(F.col("own")).cast("int").alias("fault"))


def digest() -> Column:
    """Of conversation, role and text, as 16 bytes: what is the same turn said again."""
    said = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return F.unhex(F.md5(said)).alias("digest")


def in_chunks(light: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """`marked` rows in order, packed: CHUNKS, ordered by `at` within a conversation."""
    order = ["conv", "turn", "role", "digest"]
    dealt = light.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = light.schema["conv"].dataType
    schema = CHUNKS.format(kind=kind.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            nonlocal done
            initials = [r[1][:1] for r in held]
            codes = bytes(4 * r[4] + (INITIALS.find(i) if i and i in INITIALS else 3) for r, i in zip(held, initials, strict=True))
            more = np.array([r[3] - 1 for r in held], np.int64)
            numbers = [r[0] for r in held if r[0] is not None]
            twice = sum(r[3] - 1 for r in held)  # equal rows are neighbours with equal initials
            wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)) + twice
            out.append((conv, base + done, codes, more.tobytes(), b"".join(r[2] for r in held), min(numbers, default=None), max(numbers, default=None), initials[0], initials[-1], len(set(numbers)), wrong))
            done += 1
            held.clear()

        def flush() -> pa.RecordBatch:
            names = [c.split()[0] for c in schema.split(", ")]
            types = [conv_type, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return made

        conv, conv_type = None, None
        for batch in batches:
            conv_type = batch.column("conv").type
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (key != conv or len(held) >= chunk):
                    close()
                    if len(out) >= 1000:
                        yield flush()
                conv = key
                held.append(row)
        if held:
            close()
        if out:
            yield flush()

    return dealt.select("conv", "turn", "role", "digest", "n", "fault").mapInArrow(run, schema)


def laid_out(codes: list[bytes], more: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of chunks of similar length: their numbers, codes as time x chunks (16 after the end), deletions of equal rows."""
    lengths = np.array([len(c) for c in codes])
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        limit = int(lengths[order[at]]) * 5 // 4 + 4
        upto = min(int(np.searchsorted(lengths[order], limit, "right")), at + max(1, CELLS // (4 * limit)))
        rows = order[at:upto]
        time = int(lengths[rows[-1]])
        told, extra = np.full((time, len(rows)), 16, np.uint8), np.zeros((time, len(rows)), np.int64)
        for k, i in enumerate(rows):
            told[: lengths[i], k] = np.frombuffer(codes[i], np.uint8)
            extra[: lengths[i], k] = np.frombuffer(more[i], np.int64)
        yield rows, told, extra
        at = upto


#: By code: cost of keeping a row, state after keeping it from each state (-1: not allowed), cost of giving it another role.
KEEP, REROLED = np.full(17, FAR, np.int64), np.full(17, FAR, np.int64)
NEXT = np.full((17, 4), -1)
for _fault in (FINE, CUT_OFF):
    for _initial in range(4):
        _code = 4 * _fault + _initial
        REROLED[_code] = REROLE + TRUNCATED * (_fault == CUT_OFF)
        KEEP[_code] = TRUNCATED * (_fault == CUT_OFF) if _initial < 3 else FAR
        NEXT[_code] = ([SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1] * 4)[_initial]
#: The state after a user or assistant turn is added: the open pair is closed, or a pair opened.
ADDED = np.array([USER, USER, ASSISTANT, USER])


def with_insertions(costs: np.ndarray) -> np.ndarray:
    """Costs by state (first axis) where turns may also be inserted before going on: two at most are of use."""
    for _ in range(2):
        costs = np.minimum(costs, costs[ADDED] + INSERT)
    return costs


def backward(told: np.ndarray, extra: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to the end: time + 1 x states x chunks [x goals]; `end` is states x chunks [x goals] at the end of the chunk."""
    time = len(told)
    costs = np.empty((time + 1, *end.shape), np.int64)
    costs[time] = with_insertions(end)
    wide = (slice(None), *[None] * (end.ndim - 2))
    for t in range(time - 1, -1, -1):
        code, later = told[t], costs[t + 1]
        best = later + (DELETE + 0 * code.astype(np.int64))[wide]
        for state in range(4):
            after = NEXT[code, state]
            kept = np.take_along_axis(later, np.maximum(after, 0).reshape(1, -1, *[1] * (end.ndim - 2)), 0)[0]
            best[state] = np.minimum(best[state], np.where(after >= 0, KEEP[code], FAR)[wide] + kept)
        best = np.minimum(best, REROLED[code][wide] + later[ADDED])
        best += (DELETE * extra[t])[wide]
        best = np.where((code == 16)[wide], later, with_insertions(best))
        costs[t] = np.minimum(best, FAR)
    return costs


def traced(told: np.ndarray, extra: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Steps of the ASCII-least cheapest edits: (time, chunks, edit's byte, state after it). At the end of a conversation's
    last chunk (`last`) what is missing is inserted; at other chunks' ends that is left to the next one."""
    every = np.arange(told.shape[1])
    state = state.copy()
    for t in range(len(told) + 1):
        moving = every[told[t] != 16] if t < len(told) else every[last]
        while len(moving):
            now = costs[t, state[moving], moving]
            code = told[t, moving] if t < len(told) else np.full(len(moving), 16)
            spare = DELETE * extra[t, moving] if t < len(told) else 0
            later = costs[t + 1][:, moving] if t < len(told) else np.full((4, len(moving)), FAR)
            pick = np.arange(len(moving))
            own = state[moving]
            delete = (code != 16) & (later[own, pick] + DELETE + spare == now)
            insert = ~delete & (costs[t, ADDED[own], moving] + INSERT == now)
            after = NEXT[code, own]
            keep = ~delete & ~insert & (after >= 0) & (KEEP[code] + later[np.maximum(after, 0), pick] + spare == now)
            rerole = ~delete & ~insert & ~keep & (code != 16) & (REROLED[code] + later[ADDED[own], pick] + spare == now)
            state[moving] = np.where(keep, after, np.where(insert | rerole, ADDED[own], own))
            done = delete | insert | keep | rerole
            yield t, moving[done], np.select([delete, insert, keep], [68, 73, 75], 82)[done].astype(np.uint8), state[moving][done]
            moving = moving[insert]
    yield len(told) + 1, every, np.zeros(len(every), np.uint8), state


def matrices(chunks: DataFrame) -> DataFrame:
    """(conv, at, costs: 16 longs, from each state to each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goal = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
        for batch in batches:
            codes, more = batch.column("codes").to_pylist(), batch.column("more").to_pylist()
            found: list = [None] * len(codes)
            for rows, told, extra in laid_out(codes, more):
                costs = backward(told, extra, np.broadcast_to(goal[:, None, :], (4, len(rows), 4)))[0]
                for k, i in enumerate(rows):
                    found[i] = costs[:, k].astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("at"), pa.array(found, pa.binary())], ["conv", "at", "costs"])

    return chunks.select("conv", "at", "codes", "more").mapInArrow(run, f"conv {chunks.schema['conv'].dataType.simpleString()}, at long, costs binary")


def passed_on(table: DataFrame, column: str, name: str, forward: bool) -> DataFrame:
    """(conv, at, name): what reaches each chunk, handed on along a conversation; a row is held at a time.

    Backwards a chunk's matrix (`column`) makes the costs before it of those after it; forwards its map of states.
    """
    dealt = table.select("conv", "at", column).repartition("conv").sortWithinPartitions("conv", F.col("at") if forward else F.desc("at"))
    kind = "long" if forward else "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, begun = None, None, False
        for batch in batches:
            reached = []
            for key, data in zip(batch.column("conv").to_pylist(), batch.column(column).to_pylist(), strict=True):
                if not begun or key != conv:
                    conv, now, begun = key, 0 if forward else END, True
                reached.append(now if forward else now.tobytes())
                if forward:
                    now = int(data[now])
                else:
                    now = np.minimum((np.frombuffer(data, np.int64).reshape(4, 4) + now[None, :]).min(axis=1), FAR)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("at"), pa.array(reached, pa.int64() if forward else pa.binary())], ["conv", "at", name])

    return dealt.mapInArrow(run, f"conv {table.schema['conv'].dataType.simpleString()}, at long, {name} {kind}")


def state_maps(chunks: DataFrame) -> DataFrame:
    """`chunks` with `after` (the costs at their ends) -> (conv, at, after, moves: the state each state is left in)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, more, after = (batch.column(c).to_pylist() for c in ("codes", "more", "after"))
            found: list = [None] * len(codes)
            for rows, told, extra in laid_out(codes, more):
                end = np.stack([np.frombuffer(after[i], np.int64) for i in rows], axis=1)
                costs = backward(told, extra, end)
                lefts = []
                for state in range(4):
                    *_, (_, _, _, left) = traced(told, extra, costs, np.full(len(rows), state), np.zeros(len(rows), bool))
                    lefts.append(left)
                for k, i in enumerate(rows):
                    found[i] = bytes(int(x[k]) for x in lefts)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("at"), batch.column("after"), pa.array(found, pa.binary())], ["conv", "at", "after", "moves"])

    return chunks.select("conv", "at", "codes", "more", "after").mapInArrow(run, f"conv {chunks.schema['conv'].dataType.simpleString()}, at long, after binary, moves binary")


def edits(chunks: DataFrame) -> DataFrame:
    """Chunks with `after`, `state` and `last` -> (conv, at, place, edit piece or null, digest or null, role or null).

    A row with `audit` for each chunk (place -1), and one for each turn that stays or is added, with its place in the
    chunk: kept ones have a digest only, reroled ones a digest and a role, inserted ones a role only.
    """
    kind = chunks.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, more, digests, after, start, last = (batch.column(c).to_pylist() for c in ("codes", "more", "digests", "after", "state", "last"))
            convs, ats = batch.column("conv"), batch.column("at").to_numpy()
            for rows, told, extra in laid_out(codes, more):
                costs = backward(told, extra, np.stack([np.frombuffer(after[i], np.int64) for i in rows], axis=1))
                steps = [s for s in traced(told, extra, costs, np.array([start[i] for i in rows]), np.array([last[i] for i in rows]))][:-1]
                times = np.concatenate([np.full(len(w), t) for t, w, _, _ in steps] or [[]]).astype(np.int64)
                which, made, states = (np.concatenate([s[k] for s in steps] or [np.empty(0)]).astype(np.int64) for k in (1, 2, 3))
                order = np.argsort(which, kind="stable")
                times, which, made, states = times[order], which[order], made[order], states[order]
                bounds = np.searchsorted(which, np.arange(len(rows) + 1))
                audits = []
                for k, i in enumerate(rows):
                    own = slice(bounds[k], bounds[k + 1])
                    again = np.frombuffer(more[i], np.int64)
                    # Equal rows that follow the first are deleted right after its own edit.
                    mine, when = made[own], times[own]
                    wide = np.where((mine != 73) & (when < len(again)), again[np.minimum(when, len(again) - 1)], 0)
                    letters = np.full(len(mine) + int(wide.sum()), 68, np.uint8)
                    letters[np.arange(len(mine)) + np.cumsum(wide) - wide] = mine
                    audits.append(letters.tobytes().decode())
                stay = np.flatnonzero(made != 68)
                place = np.arange(len(made)) - bounds[which]
                chosen = rows[which[stay]]
                hashes = [None if made[s] == 73 else digests[rows[which[s]]][16 * times[s] : 16 * times[s] + 16] for s in stay]
                roles = [None if made[s] == 75 else ("user" if states[s] == USER else "assistant") for s in stay]
                none, n = pa.nulls(len(rows), pa.binary()), len(rows)
                names = ["conv", "at", "place", "audit", "digest", "new_role"]
                yield pa.RecordBatch.from_arrays([convs.take(pa.array(rows)), pa.array(ats[rows]), pa.array(np.full(n, -1)), pa.array(audits, pa.string()), none, pa.nulls(n, pa.string())], names)
                yield pa.RecordBatch.from_arrays([convs.take(pa.array(chosen)), pa.array(ats[chosen]), pa.array(place[stay]), pa.nulls(len(stay), pa.string()), pa.array(hashes, pa.binary()), pa.array(roles, pa.string())], names)

    needed = chunks.select("conv", "at", "codes", "more", "digests", "after", "state", "last")
    return needed.mapInArrow(run, f"conv {kind}, at long, place long, audit string, digest binary, new_role string")


def on_chunk(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by conversation (which may be null) and chunk."""
    named = right.withColumnsRenamed({"conv": "__conv", "at": "__at"})
    return left.join(named, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("at") == F.col("__at")), how).drop("__conv", "__at")


def hashed(pieces: DataFrame) -> DataFrame:
    """Pieces of audits and lines of repaired text, in order of (at, place) -> one row for each conversation."""
    kind = pieces.schema["conv"].dataType.simpleString()
    dealt = pieces.repartition("conv").sortWithinPartitions("conv", "at", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, audit, sha, lines, out = None, False, [], None, 0, []
        names, kinds = ["conv", "audit", "repaired_sha256"], None

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            kinds = [batch.column("conv").type, pa.string(), pa.string()]
            for key, piece, line in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "line")), strict=True):
                if not begun or key != conv:
                    if begun:
                        out.append((conv, "".join(audit), sha.hexdigest()))
                    conv, begun, audit, sha, lines = key, True, [], hashlib.sha256(), 0
                    if len(out) >= 10_000:
                        yield flush()
                if piece is not None:
                    audit.append(piece)
                if line is not None:
                    sha.update(b"\n" * bool(lines) + line.encode())
                    lines += 1
        if begun:
            out.append((conv, "".join(audit), sha.hexdigest()))
            yield flush()

    return dealt.select("conv", "audit", "line").mapInArrow(run, f"conv {kind}, audit string, repaired_sha256 string")


def numbers(chunks: DataFrame) -> DataFrame:
    """(conv, gaps, illegal) from what each chunk knows and from the borders between a conversation's chunks.

    A chunk's row is small; a conversation has one for some thousand rows. The window goes over them.
    """
    from pyspark.sql import Window

    over = Window.partitionBy("conv").orderBy("at")
    before = lambda c: F.lag(c).over(over)
    pair = F.concat(before("last_initial"), F.col("first_initial"))
    met = chunks.select("conv", "turns", "illegal", "first_turn", "last_turn", F.coalesce((~pair.isin("su", "ua", "au")).cast("int"), F.lit(0)).alias("wrong"), F.coalesce((before("last_turn") == F.col("first_turn")).cast("int"), F.lit(0)).alias("shared"))
    gaps = F.max("last_turn") - F.min("first_turn") + 1 - F.sum(F.col("turns") - F.col("shared"))
    return met.groupBy("conv").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), F.sum(F.col("illegal") + F.col("wrong")).cast("long").alias("illegal"))


def cheapest(audit: Column, kept_truncated: Column) -> Column:
    """An audit's cost: its edits, and what truncated rows that stay cost."""
    n = lambda c: F.length(audit) - F.length(F.replace(audit, F.lit(c), F.lit("")))
    return n("R") * REROLE + n("D") * DELETE + n("I") * INSERT + kept_truncated * TRUNCATED


def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """`rows` (conv, turn, role, text, n) -> (what a conversation is found to be, its repaired lines in order).

    The first has a row for each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. The second has (conv, at, place, role, text) of the turns of the repaired conversations.
    Rows go by turn, missing numbers first, rows of one turn by role and then the digest of role and text. Roles and texts
    are not null. Rows without conv are one conversation. Equal rows are repeated turns, all but the first duplicates.
    An empty table gives empty results. Texts of any length are shuffled and hashed, never compared.
    """
    light = cut(marked(rows))
    chunks = cut(in_chunks(light, chunk))
    many = chunks.groupBy("conv").agg(F.count("*").alias("parts"), F.max("at").alias("last_at"))
    longer = many.where("parts > 1")
    whole = chunks.withColumns({"after": F.lit(END.tobytes()), "state": F.lit(0).cast("long"), "last": F.lit(True)})
    ready = whole
    if not longer.isEmpty():
        own = F.col("conv").eqNullSafe(F.col("__of"))
        renamed = longer.withColumnRenamed("conv", "__of")
        parts = chunks.join(renamed, own).drop("__of")
        after = cut(passed_on(matrices(parts), "costs", "after", forward=False))
        moves = cut(state_maps(on_chunk(parts, after)))
        state = passed_on(moves, "moves", "state", forward=True)
        reached = on_chunk(moves.select("conv", "at", "after"), state)
        ready = whole.join(renamed, own, "left_anti").unionByName(on_chunk(parts, reached).withColumn("last", F.col("at") == F.col("last_at")).select(whole.columns))
    made = cut(edits(ready))
    staying = made.where("place >= 0").select("conv", "at", "place", "digest", "new_role")
    texts = rows.select(digest(), "role", "text").groupBy("digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    kept = staying.where("digest is not null").join(texts, "digest")
    lines = kept.select("conv", "at", "place", F.coalesce("new_role", "role").alias("role"), "text").unionByName(staying.where("digest is null").select("conv", "at", "place", F.col("new_role").alias("role"), F.lit("").alias("text")))
    pieces = made.where("place < 0").select("conv", "at", "place", "audit", F.lit(None).cast("string").alias("line")).unionByName(lines.select("conv", "at", "place", F.lit(None).cast("string").alias("audit"), F.concat("role", F.lit(":"), "text").alias("line")))
    faults = light.groupBy(F.col("conv").alias("f")).agg(
        F.sum(F.when(F.col("fault") == BLANK, F.col("n")).otherwise(0)).cast("long").alias("blank"),
        F.sum(F.when(F.col("fault") == BLANK, 0).when(F.col("fault") == DUPLICATE, F.col("n")).otherwise(F.col("n") - 1)).cast("long").alias("duplicate"),
        F.sum((F.col("fault") == CUT_OFF).cast("long")).alias("truncated"),
    )
    cut_off = light.where(F.col("fault") == CUT_OFF).select("digest")
    stayed = staying.join(cut_off, "digest").groupBy(F.col("conv").alias("t")).agg(F.count("*").alias("stayed"))
    same = lambda c: F.col("conv").eqNullSafe(F.col(c))
    joined = hashed(pieces).join(numbers(chunks).withColumnRenamed("conv", "g"), same("g")).join(faults, same("f")).join(stayed, same("t"), "left")
    cost = cheapest(F.col("audit"), F.coalesce("stayed", F.lit(0))).cast("long")
    return joined.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", cost.alias("cost"), "audit", "repaired_sha256"), lines


def op13(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each conv_id of `conversations` (conv_id, turn, role, text), damaged as planted and repaired.

    Null roles and texts are one space, so the text is blank; conversations that lose all rows have zeros, an empty audit and
    the digest of nothing. Other columns are not looked at. For the rest see `repair`.
    """
    needed = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    found, _ = repair(damaged(needed).withColumnRenamed("conv_id", "conv"), chunk)
    every = needed.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    whole = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def oracle() -> str:
    """`op13` in DuckDB: the least of all ways forwards, each as a string of its cost (ten digits) and its edits."""

    def way(state: str, cost: str, letter: str) -> str:
        return f"(lpad((substr({state}, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({state}, 11) || '{letter}')"

    added = lambda s: way(s, "5", "I")
    inserted = f"""SELECT *, least(u1, {added("a1")}) AS u2 FROM (SELECT *, least(a, {added("u1")}) AS a1 FROM (SELECT *, least(u, {added("z")}, {added("s")}, {added("a")}) AS u1 FROM {{}}))"""
    stays = lambda state, cost, letter, when: f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND {when} THEN {way(state, f'{cost} + CASE WHEN fault = {chr(39)}truncated{chr(39)} THEN 5 ELSE 0 END', letter)} END"
    users = ", ".join(f"{stays(x, 0, 'K', 'initial = ' + repr('u'))}, {stays(x, 1, 'R', 'true')}" for x in ("z", "s", "a1"))
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE
crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
keyed AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
drawn AS (SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(place) + 1), lambda i: ord(substr(place, i::INTEGER, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM keyed, crc),
damaged AS (SELECT c, conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) FROM drawn WHERE k <> 0),
placed AS (SELECT c, turn, role, text, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(coalesce(conv_id::VARCHAR, ' ') || ':' || strlen(role) || ':' || role || text)) AS i FROM damaged),
rows AS (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY i) AS before,
         CASE WHEN rtrim(text, {white}) = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(rtrim(text, {white}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault FROM placed),
ways AS (
  SELECT c, 0::BIGINT AS i, '0000000000' AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM (SELECT DISTINCT c FROM rows)
  UNION ALL
  SELECT c, i, {way("z", "2", "D")}, least({way("s", "2", "D")}, {stays("z", 0, "K", "initial = 's'")}),
         least({way("u2", "2", "D")}, {users}),
         least({way("a1", "2", "D")}, {stays("u2", 0, "K", "initial = 'a'")}, {stays("u2", 1, "R", "true")})
  FROM ({inserted.format("(SELECT rows.c, rows.i, fault, initial, z, s, u, a FROM ways JOIN rows ON rows.c = ways.c AND rows.i = ways.i + 1)")})),
ends AS (SELECT c, i, least(z, a1) AS best FROM ({inserted.format("ways")})),
audits AS (SELECT c, substr(best, 1, 10)::BIGINT AS cost, substr(best, 11) AS audit FROM ends WHERE (c, i) IN (SELECT c, max(i) FROM rows GROUP BY c)),
steps AS (SELECT c, p, letter, sum((letter <> 'I')::INTEGER) OVER w AS i, sum((letter <> 'D')::INTEGER) OVER w AS o
          FROM (SELECT c, unnest(range(1, length(audit) + 1)) AS p, unnest(string_split(audit, '')) AS letter FROM audits WHERE audit <> '') WINDOW w AS (PARTITION BY c ORDER BY p)),
given AS (SELECT c, p, o, letter, role, text, coalesce(max((o = 1 AND letter = 'K' AND initial = 's')::INTEGER) OVER (PARTITION BY c), 0) AS opening FROM steps LEFT JOIN rows USING (c, i) WHERE letter <> 'D'),
texts AS (SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - opening) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t FROM given GROUP BY c),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM keyed) LEFT JOIN counts USING (c) LEFT JOIN audits USING (c) LEFT JOIN texts USING (c)
"""


ORACLE = oracle()
