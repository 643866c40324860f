"""Batched local alignment scores (affine gaps) with numpy: one column of the arrays for each subject.

With H the best score of an alignment ending at a pair of positions, a gap of length k costs gop + (k - 1) * gex. For
one query residue at a time, all subjects' rows are made: gaps in the subject (F) from the row before, then gaps in the
query (E) as a running maximum along the subjects. Values are kept less gex times their position, so that extending a
gap along a subject changes nothing and needs no step of its own.

A long subject is worked off in tiles of positions; what a tile leaves at its right edge, a value of H and of E for each
query residue, is where the next one begins. So the arrays are those of a tile, however long the subject is.

`upper_bounds` is for many queries: bounds that are a few points above the scores at most, with fewer and cheaper steps.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np

from seqscan.functions.residues import OTHER

#: Elements of one working array: small enough for a core's cache.
BLOCK_CELLS = 1 << 16
#: Positions of a subject that are worked off at once.
TILE = 1 << 18
#: Steps of `upper_bounds` between two corrections. Multiples of six only, after which its buffers stand as they began.
STEPS = 6
#: Elements of one working array of `upper_bounds`, and of the scores against one residue, about; columns of them.
LANES, PLANE = 128 << 10, 3 << 20
WIDTHS = (1, 2, 4, 8, 16, 32, 48, 64, 96, 128, 192, 256, 320)
#: Queries beyond these lengths are scored exactly instead: bounds of short ones tell too little, long ones fill the caches.
BOUNDED = 64, 4096
#: Stands for a bound that 8 bits don't hold.
BEYOND = np.iinfo(np.int32).max


def number_type(table: np.ndarray, gop: int, gex: int, m: int, n: int) -> type:
    """int16 while no score, ramp or gap sum can leave it."""
    reach = int(table.max()) * min(m, n) + abs(gex) * (n + 3) + 2 * abs(gop) + int(abs(table).max())
    return np.int16 if reach < 20_000 else np.int32


class Block:
    """Subjects of similar length, as a positions x subjects array of codes, and their scores against each residue."""

    def __init__(self, subjects: np.ndarray, table: np.ndarray):
        self.subjects, self.table = subjects, table
        self.layers: dict[tuple[type, int], np.ndarray] = {}

    def layer(self, kind: type, code: int, less: int = 0) -> np.ndarray:
        """Scores of one residue against all positions, each less a constant; made once for all queries."""
        key = kind, code, less
        if key not in self.layers:
            self.layers[key] = (self.table[code] - less).astype(kind)[self.subjects]
        return self.layers[key]


class Edge:
    """The right edge of a tile: H before the first and after each query residue, E after each, for all subjects."""

    def __init__(self, m: int, count: int):
        self.h, self.e = np.zeros((m + 1, count), np.int32), np.full((m, count), -1_000_000_000, np.int32)


def block_scores(query: np.ndarray, block: Block, gop: int, gex: int, edge: Edge | None = None) -> np.ndarray:
    """Scores of one query (codes) against the subjects of a block, padded with `other`.

    With `edge` the block is a tile: it begins at that edge and leaves its own one there.
    """
    n, count = block.subjects.shape
    if not len(query) or not n or not count:
        return np.zeros(count, np.int32)
    kind = number_type(block.table, gop, gex, len(query), n) if edge is None else np.int32
    floor = kind(-10_000 if kind is np.int16 else -1_000_000_000)
    gop, gex = kind(gop), kind(gex)
    f = np.full((n, count), floor)
    best, t, x = (np.zeros((n, count), kind) for _ in range(3))
    if gop <= gex:
        ramp = (np.arange(-1, n, dtype=kind) * gex)[:, None]
        h = np.zeros((n + 1, count), kind) - ramp  # row 0 is the border before the first position
        none, step = -ramp[1:], kind(gop - gex)
        best += none
        left = edge.h.copy() if edge else None
        for i, code in enumerate(query.tolist()):
            if edge:
                h[0] = left[i] - ramp[0]
            np.add(f, gex, out=f)
            np.add(h[1:], gop, out=x)
            np.maximum(f, x, out=f)
            np.add(h[:-1], block.layer(kind, code, int(gex)), out=t)
            np.maximum(t, f, out=t)
            np.maximum(t, none, out=t)
            np.maximum.accumulate(t, axis=0, out=x)
            np.add(x[:-1], step, out=x[:-1])
            h[1] = t[0]
            np.maximum(t[1:], x[:-1], out=h[2:])
            if edge:
                entering = np.maximum(edge.e[i] + gex, left[i + 1] + gop)
                np.maximum(h[1:], entering, out=h[1:])
                edge.e[i] = np.maximum(entering, x[n - 2] if n > 1 else floor) + ramp[n]
                edge.h[i + 1] = h[n] + ramp[n]
            np.maximum(best, h[1:], out=best)
        return (best + ramp[1:]).max(axis=0).astype(np.int32)
    # Opening costs less than extending: gaps of both kinds may follow each other, so positions go one by one.
    h = np.zeros((n + 1, count), kind)
    left = edge.h.copy() if edge else None
    for i, code in enumerate(query.tolist()):
        if edge:
            h[0] = left[i]
        np.maximum(f + gex, h[1:] + gop, out=f)
        np.add(h[:-1], block.layer(kind, code), out=t)
        np.maximum(t, f, out=t)
        np.maximum(t, 0, out=t)
        gap = edge.e[i] if edge else np.full(count, floor)
        for j in range(n):
            gap = np.maximum(np.maximum(gap + gex, h[j] + gop if j else left[i + 1] + gop if edge else gop), floor)
            h[j + 1] = np.maximum(t[j], gap)
        if edge:
            edge.e[i], edge.h[i + 1] = gap, h[n]
        np.maximum(best, h[1:], out=best)
    return best.max(axis=0).astype(np.int32)


def grouped(lengths: np.ndarray) -> list[np.ndarray]:
    """Row numbers in groups of similar length, each a block of about BLOCK_CELLS."""
    order = np.argsort(lengths, kind="stable")
    groups, at = [], 0
    while at < len(order):
        shortest = max(int(lengths[order[at]]), 16)
        limit = shortest + shortest // 8 + 4
        upto = at + max(1, int(np.searchsorted(lengths[order[at:]], limit, "right")))
        longest = max(int(lengths[order[min(upto, len(order)) - 1]]), 1)
        upto = min(upto, at + max(8, BLOCK_CELLS // longest), len(order))
        groups.append(order[at:upto])
        at = upto
    return groups


def stacked(subjects: Sequence[bytes], rows: np.ndarray, other: int = 20) -> np.ndarray:
    n = max((len(subjects[i]) for i in rows), default=0)
    out = np.full((n, len(rows)), other, np.uint8)
    for k, i in enumerate(rows):
        out[: len(subjects[i]), k] = np.frombuffer(subjects[i], np.uint8)
    return out


def all_scores(queries: Sequence[bytes], subjects: Sequence[bytes], table: np.ndarray, gop: int, gex: int) -> np.ndarray:
    """Scores of every query against every subject (codes): queries x subjects, int32. Empty sequences score 0."""
    distinct = {q: np.frombuffer(q, np.uint8) for q in queries}
    out = np.zeros((len(queries), len(subjects)), np.int32)
    if subjects:
        for rows in grouped(np.array([len(s) for s in subjects])):
            whole = stacked(subjects, rows)
            if len(whole) <= TILE:
                block = Block(whole, table)
                found = {q: block_scores(codes, block, gop, gex) for q, codes in distinct.items()}
            else:
                found = {q: np.zeros(len(rows), np.int32) for q in distinct}
                edges = {q: Edge(len(q), len(rows)) for q in distinct}
                for at in range(0, len(whole), TILE):
                    block = Block(whole[at : at + TILE], table)
                    for q, codes in distinct.items():
                        np.maximum(found[q], block_scores(codes, block, gop, gex, edges[q]), out=found[q])
            for k, q in enumerate(queries):
                out[k, rows] = found[q]
    return out


def pair_scores(pairs: Sequence[tuple[bytes, bytes]], table: np.ndarray, gop: int, gex: int) -> np.ndarray:
    """Scores of pairs; those that share a query are done together."""
    by_query: dict[bytes, list[int]] = defaultdict(list)
    for i, (q, _) in enumerate(pairs):
        by_query[q].append(i)
    out = np.zeros(len(pairs), np.int32)
    for q, rows in by_query.items():
        out[rows] = all_scores([q], [pairs[i][1] for i in rows], table, gop, gex)[0]
    return out


def slack(bounds: np.ndarray, gop: int, gex: int) -> np.ndarray:
    """How far `upper_bounds` are above the scores at most; the least bound tells nothing more."""
    return np.where(bounds <= -gop - gex * (STEPS - 1), bounds, 2 * -gex * (STEPS - 1))


def bounds_fit(table: np.ndarray, gop: int, gex: int) -> bool:
    """Whether bounds of some use fit into 8 bits; opening a gap must not cost less than extending one."""
    return gop <= gex < 0 and int(table[OTHER].max()) < 0 and full(table, gop, gex) - zero(table, gop) + 2 * gex * STEPS >= 100


def zero(table: np.ndarray, gop: int) -> int:
    """What stands for a score of 0: nothing that is subtracted goes below it by more."""
    return max(-gop, -int(table.min()))


def full(table: np.ndarray, gop: int, gex: int) -> int:
    """The value of E from which on an H beside it may have left 8 bits."""
    return 255 - (int(table.max()) - 2 * gex) + gop - gex


def span(query: np.ndarray, table: np.ndarray, gop: int, gex: int) -> int:
    """Positions of a subject that an alignment with a score above 0 takes at most."""
    gain = int(np.maximum(table.max(axis=1), 0)[query].sum())
    return len(query) + max(0, (gain + gop) // -gex + 1)


def strip_bounds(queries: Sequence[np.ndarray], layers: np.ndarray, front: int, n: int, table: np.ndarray, gop: int, gex: int) -> np.ndarray:
    """Bounds of some queries against a strip of subjects, queries x subjects, BEYOND where 8 bits don't hold them.

    Rows are the queries' residues, a border before each query, and columns are subjects. A step makes the cells of one
    antidiagonal, row i those of position step - i, so that what a cell needs stands in the same or in the row above.
    Values are kept plus gex times the step within STEPS, so that extending a gap changes nothing. Two things are put off
    to every STEPS-th step: raising values to 0, done ahead and thus by up to gex * (STEPS - 1) too high, and looking at
    the best, seen by the gaps that it opens, from which it is told with the same error.
    """
    rows, count = sum(map(len, queries)) + len(queries), layers.shape[1]
    width, steps = len(layers) // 21, -(-(max(map(len, queries)) + n) // STEPS) * STEPS
    starts = np.cumsum([0] + [len(q) + 1 for q in queries[:-1]])
    at = np.full(rows, front, np.intp)
    for start, q in zip(starts, queries, strict=True):
        at[start + 1 : start + 1 + len(q)] = q.astype(np.intp) * width + front - np.arange(len(q))
    at = at[1:].copy()
    nought = zero(table, gop)
    floor, edge, step, opening = np.array([nought - gex * (STEPS - 1), nought - gex * (STEPS - 3), -gex * STEPS, gex - gop]).astype(np.uint8)
    h = [np.full((rows, count), floor - step) for _ in range(3)]
    f = [np.full((rows, count), step) for _ in range(2)]
    for x in h:
        x[starts] = edge
    e, least, best, g = (np.full((rows, count), floor) for _ in range(4))
    inner, e1, g0 = starts[1:], e[1:], g[:-1]
    turns = [(h[k % 3], h[k % 3][1:], h[(k + 2) % 3], h[(k + 1) % 3][:-1], f[k % 2], f[k % 2][1:], f[(k + 1) % 2][:-1]) for k in range(STEPS)]
    add, subtract, maximum, take = np.add, np.subtract, np.maximum, layers.take
    for _ in range(0, steps, STEPS):
        for new, new1, one, two0, gap, gap1, before0 in turns:
            subtract(one, opening, g)
            maximum(e, g, e)
            maximum(before0, g0, gap1)
            take(at, 0, new1, "clip")
            add(new1, two0, new1)
            maximum(new1, e1, new1)
            maximum(new1, gap1, new1)
            if len(inner):
                gap[inner], new[inner] = step, edge
            at += 1
        maximum(best, e, best)
        for x in (h[1], h[2], e, f[1]):
            subtract(x, step, x)
        maximum(e, least, e)
        h[1][starts] = h[2][starts] = edge
        f[1][starts] = step
    seen = np.array([best[a + 1 : a + 1 + len(q)].max(axis=0) for a, q in zip(starts, queries, strict=True)]).astype(np.int32)
    return np.where(seen >= full(table, gop, gex), BEYOND, seen - nought - gop)


def upper_bounds(queries: Sequence[bytes], subjects: Sequence[bytes], table: np.ndarray, gop: int, gex: int) -> np.ndarray:
    """Bounds on all scores, queries x subjects: not below the score and at most `slack` above, or BEYOND.

    Takes non-empty queries, where `bounds_fit`. Subjects go in strips of similar length; long ones go in pieces that
    overlap by as much as an alignment can take.
    """
    out = np.zeros((len(queries), len(subjects)), np.int32)
    order = sorted(range(len(queries)), key=lambda k: len(queries[k]))
    codes = [np.frombuffer(q, np.uint8) for q in queries]
    plain = (table - 2 * gex).astype(np.uint8)
    while order:
        longest = max(512, 2 * len(queries[order[0]]))
        now, order = [k for k in order if len(codes[k]) <= longest], [k for k in order if len(codes[k]) > longest]
        front = len(codes[now[-1]])
        overlap = max(span(codes[k], table, gop, gex) for k in now)
        whole = max(8 * overlap, 1 << 13)
        pieces = [(i, a) for i, s in enumerate(subjects) for a in range(0, max(len(s) - overlap, min(len(s), 1)), whole - overlap)]
        owner = np.array([i for i, _ in pieces], np.intp)
        texts = [subjects[i] if len(subjects[i]) <= whole else subjects[i][a : a + whole] for i, a in pieces]
        for members in strips(np.array([len(t) for t in texts], np.intp)):
            n = len(texts[members[-1]])
            held = np.full((2 * front + n + STEPS, len(members)), OTHER, np.uint8)
            held[front : front + n] = stacked(texts, members)
            layers = np.empty((21, *held.shape), np.uint8)
            for code in range(21):
                np.take(plain[code], held, out=layers[code], mode="clip")
            layers = layers.reshape(-1, len(members))
            most = max(1, LANES // len(members))
            stack: list[int] = []
            for k in [*now, -1]:
                if stack and (k < 0 or sum(len(codes[j]) + 1 for j in stack) + len(codes[k]) >= most):
                    found = strip_bounds([codes[j] for j in stack], layers, front, n, table, gop, gex)
                    for j, row in zip(stack, found, strict=True):
                        np.maximum.at(out[j], owner[members], row)
                    stack = []
                stack.append(k)
    return out


def strips(lengths: np.ndarray) -> list[np.ndarray]:
    """Row numbers in groups of similar length for `strip_bounds`, the longest last.

    A row of a narrow strip costs as much to fetch as some 20 of its columns, a wide strip is longer than most of its
    subjects: of some widths the one that costs least for what it holds.
    """
    order = np.argsort(lengths, kind="stable")
    upto = np.concatenate(([0], np.cumsum(lengths[order])))
    groups, at = [], 0
    while at < len(order):
        widths = np.array([w for w in (*WIDTHS, len(order) - at) if w <= min(len(order) - at, WIDTHS[-1])])
        longest = lengths[order[at + widths - 1]]
        cost = np.where((widths > 1) & (widths * longest > PLANE), np.inf, (widths + 20) * longest / (upto[at + widths] - upto[at]))
        width = int(widths[np.argmin(cost)])
        groups.append(order[at : at + width])
        at += width
    return groups
