"""Alignments that need a way back through the table: an Arrow batch at a time, a pair a row.

Texts of like lengths share a table, of which a diagonal of all texts is made at once; of the table only the way back is kept, a byte a
cell. What a pair of words costs is made once a pair of distinct words of two texts, for many pairs of like lengths at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.distance import STATIC_COSTS, cost_table

#: Cells of tables and pairs of words that are made at once, pairs of words in one step, and so few pairs that they are taken one by one.
CELLS, STEP, FEW = 1 << 20, 1 << 13, 32
PAIR, LEFT_OUT, PUT_IN = 0, 1, 2


def path(a: list, b: list, cost: Callable[[object, object], float]) -> list[tuple[int | None, int | None]]:
    """Pairs of places of the cheapest alignment, insertions and deletions at cost 1 (the other place is None); on ties a pair is taken before a deletion, a deletion before an insertion."""
    n, m = len(a), len(b)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i or j:
                best[i][j] = min(best[i - 1][j - 1] + cost(a[i - 1], b[j - 1]) if i and j else float("inf"), best[i - 1][j] + 1 if i else float("inf"), best[i][j - 1] + 1 if j else float("inf"))
    out, i, j = [], n, m
    while i or j:
        if i and j and abs(best[i][j] - best[i - 1][j - 1] - cost(a[i - 1], b[j - 1])) < 1e-9:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and abs(best[i][j] - best[i - 1][j] - 1) < 1e-9:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def word_distance(a: str, b: str, costs: dict[str, float] = STATIC_COSTS) -> float:
    a, b = a.lower(), b.lower()
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [i + 1.0]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (0.0 if x == y else costs.get(f"{min(x, y)},{max(x, y)}", 1.0))))
        row = new
    return row[-1]


def token_cost(s: str, t: str) -> float:
    return 0.0 if s == t else min(word_distance(s, t) / max(len(s), len(t), 1), 2.0)


def _class(n: int) -> int:
    """Words of up to 8 letters share a table with words of their length, longer ones with some up to a quarter longer."""
    c = 8
    while c < n:
        c += c // 4
    return n if n <= 8 else c


class _Words:
    """Distinct words and the costs of pairs of them. The letters of words of one class are one array, by place, then word."""

    def __init__(self, words: list[str]):
        self.words, self.number = words, {w: i for i, w in enumerate(words)}
        low = [w.lower() for w in words]
        self.low, self.size, self.length = low, np.array([len(w) for w in low]), np.array([len(w) for w in words])
        self.kind, self.row, self.letters = np.zeros(len(words), int), np.zeros(len(words), int), {}
        members: dict[int, list[int]] = {}
        for i, w in enumerate(low):
            members.setdefault(_class(len(w)), []).append(i)
        for c, at in members.items():
            self.kind[at], self.row[at] = c, np.arange(len(at))
            # as code points, which a surrogate has as well
            self.letters[c] = np.array([[*map(ord, low[i]), *[0] * (c - len(low[i]))] for i in at], np.int32).reshape(len(at), c).T
        self.table = cost_table(STATIC_COSTS)
        self.table[np.arange(127), np.arange(127)] = 0.0
        self.table = self.table.reshape(-1)

    def costs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`token_cost` of pairs of words, given by number."""
        out = np.zeros(len(a))
        key = self.kind[a] * (int(self.kind.max(initial=0)) + 1) + self.kind[b]
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
            if hi - lo < FEW:
                for i in order[lo:hi]:
                    out[i] = word_distance(self.low[a[i]], self.low[b[i]])
                continue
            for at in range(lo, hi, STEP):
                some = order[at : min(at + STEP, hi)]
                out[some] = self._distances(a[some], b[some])
        return np.minimum(out / np.maximum(np.maximum(self.length[a], self.length[b]), 1), 2.0)

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of words of one class and of another: a cell of all tables at a time."""
        x, y = self.letters[int(self.kind[a[0]])][:, self.row[a]], self.letters[int(self.kind[b[0]])][:, self.row[b]]
        nx, ny = self.size[a], self.size[b]
        one_ascii = min(x.max(initial=0), y.max(initial=0)) < 127
        known_x, known_y = np.minimum(x, 127).astype(np.intp) * 128, np.minimum(y, 127).astype(np.intp)
        row = np.repeat(np.arange(len(y) + 1, dtype=float)[:, None], len(a), 1)
        found = np.where(nx == 0, ny, 0).astype(float)
        least = int(nx.min())
        for i in range(len(x)):
            done = np.empty_like(row)
            done[0] = i + 1
            for j in range(len(y)):
                sub = self.table.take(known_x[i] + known_y[j])
                if not one_ascii:
                    sub[x[i] == y[j]] = 0.0
                sub += row[j]
                np.minimum(sub, row[j + 1] + 1, out=sub)
                np.minimum(sub, done[j] + 1, out=done[j + 1])
            row = done
            if i + 1 >= least:
                ends = np.flatnonzero(nx == i + 1)
                found[ends] = row[ny[ends], ends]
        return found


def _groups(a: list[list[str]], b: list[list[str]]) -> Iterator[list[int]]:
    """Pairs of texts of like lengths, as many as CELLS cells are enough for, or one."""
    group, n, m, kind = [], 0, 0, -1
    for k in sorted(range(len(a)), key=lambda k: (len(a[k]) // 32, len(b[k]))):
        n2, m2 = max(n, len(a[k])), max(m, len(b[k]))
        if group and (len(a[k]) // 32 != kind or (len(group) + 1) * (n2 + 1) * (m2 + 1) > CELLS):
            yield group
            group, n2, m2 = [], len(a[k]), len(b[k])
        group.append(k)
        n, m, kind = n2, m2, len(a[k]) // 32
    if group:
        yield group


def moves(a: list[list[str]], b: list[list[str]]) -> Iterator[tuple[int, list[int]]]:
    """(k, the moves of `path` for a[k] and b[k] under `token_cost`: PAIR, LEFT_OUT of a, PUT_IN of b), every k once, in any order."""
    for group in _groups(a, b):
        yield from zip(group, _moves([a[k] for k in group], [b[k] for k in group]), strict=True)


def _moves(a: list[list[str]], b: list[list[str]]) -> Iterator[list[int]]:
    words = _Words(list(dict.fromkeys(w for side in (a, b) for ws in side for w in ws)))
    n, m = max(map(len, a)), max(map(len, b))
    # where a place's word begins in the costs, and what is added for the other's
    first, second = np.zeros((n, len(a)), int), np.zeros((m, len(a)), int)
    parts, waiting, base, held = [], [], 0, 0

    def flush() -> None:
        if waiting:
            parts.append(words.costs(np.concatenate([x for x, _ in waiting]), np.concatenate([y for _, y in waiting])))
            waiting.clear()

    for g, (x, y) in enumerate(zip(a, b, strict=True)):
        if not x or not y:
            continue
        ux, uy = {w: i for i, w in enumerate(dict.fromkeys(x))}, {w: i for i, w in enumerate(dict.fromkeys(y))}
        first[: len(x), g] = base + np.array([ux[w] for w in x]) * len(uy)
        second[: len(y), g] = [uy[w] for w in y]
        base += len(ux) * len(uy)
        at_x, at_y = np.array([words.number[w] for w in ux]), np.array([words.number[w] for w in uy])
        step = max(1, CELLS // len(uy))
        for lo in range(0, len(ux), step):
            some = at_x[lo : lo + step]
            waiting.append((np.repeat(some, len(uy)), np.tile(at_y, len(some))))
            held += len(some) * len(uy)
            if held >= CELLS:
                flush()
                held = 0
    flush()
    costs = np.concatenate(parts) if parts else np.zeros(1)
    # by place in a, then place in b, then pair of texts; cells behind a text's end hold anything
    way, wide = np.zeros((n * max(m, 2), len(a)), np.uint8), max(m, 2)
    before, last = np.zeros((n + 1, len(a))), np.zeros((n + 1, len(a)))  # by place in a, of the last diagonals
    for d in range(1, n + m + 1):
        now = np.full((n + 1, len(a)), float(d))
        lo, hi = max(1, d - m), min(n, d - 1)
        if lo <= hi:
            cost = costs.take(first[lo - 1 : hi] + second[d - hi - 1 : d - lo][::-1])
            pair, out = before[lo - 1 : hi], last[lo - 1 : hi]
            best = np.minimum(np.minimum(pair + cost, out + 1), last[lo : hi + 1] + 1)
            now[lo : hi + 1] = best
            taken = np.where(np.abs(best - pair - cost) < 1e-9, PAIR, np.where(np.abs(best - out - 1) < 1e-9, LEFT_OUT, PUT_IN))
            # the cell (i, j) stands at i * wide + j, so a diagonal's lie wide - 1 apart
            begin = (lo - 1) * wide + d - lo - 1
            way[begin : begin + (hi - lo) * (wide - 1) + 1 : wide - 1] = taken
        before, last = last, now
    way = way.reshape(n, wide, len(a))
    for g, (x, y) in enumerate(zip(a, b, strict=True)):
        cells, i, j, found = way[: len(x), : len(y), g].tobytes(), len(x), len(y), []
        while i and j:
            move = cells[(i - 1) * len(y) + j - 1]
            found.append(move)
            i -= move != PUT_IN
            j -= move != LEFT_OUT
        yield [*[LEFT_OUT] * i, *[PUT_IN] * j, *found[::-1]]


def _rows(a: list[str], b: list[str], cost) -> list[dict]:
    out = []
    for i, j in path(a, b, cost):
        kind = "deletion" if j is None else "insertion" if i is None else "match" if a[i] == b[j] else "substitution"
        out.append({"kind": kind, "a": None if i is None else a[i], "b": None if j is None else b[j]})
    return out


_TYPE = "array<struct<kind:string,a:string,b:string>>"


def aligned_characters(a: Column, b: Column) -> Column:
    """Of two words in lower case: match, substitution, deletion, insertion."""

    @F.pandas_udf(_TYPE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([_rows(list((p or "").lower()), list((q or "").lower()), lambda s, t: float(s != t)) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def aligned_tokens(a: Column, b: Column) -> Column:
    """Of two texts: a pair of words costs their weighted distance as a share of the longer one's length, 2 at most."""

    @F.pandas_udf(_TYPE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            ps, qs = [(p or "").split() for p in x], [(q or "").split() for q in y]
            out: list = [None] * len(ps)
            for k, found in moves(ps, qs):
                rows, p, q = [], iter(ps[k]), iter(qs[k])
                for move in found:
                    s, t = None if move == PUT_IN else next(p), None if move == LEFT_OUT else next(q)
                    kind = "deletion" if t is None else "insertion" if s is None else "match" if s == t else "substitution"
                    rows.append({"kind": kind, "a": s, "b": t})
                out[k] = rows
            yield pd.Series(out, dtype=object)

    return run(a, b)


_COUNTS = ("total", "correct", "substitutions", "deleted", "inserted")


def counted_tokens(a: Column, b: Column) -> Column:
    """How many words of the alignment of two texts are alike, another, left out and put in, and all of them."""

    @F.pandas_udf(", ".join(f"{c} long" for c in _COUNTS))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in batches:
            ps, qs = [(p or "").split() for p in x], [(q or "").split() for q in y]
            out = np.zeros((len(ps), len(_COUNTS)), np.int64)
            for k, found in moves(ps, qs):
                i = j = same = 0
                for move in found:
                    same += move == PAIR and ps[k][i] == qs[k][j]
                    i += move != PUT_IN
                    j += move != LEFT_OUT
                pairs = found.count(PAIR)
                out[k] = len(found), same, pairs - same, found.count(LEFT_OUT), found.count(PUT_IN)
            yield pd.DataFrame(out, columns=_COUNTS)

    return run(a, b)


def evaluated(pairs: DataFrame, proposed: str, confirmed: str, key: str) -> DataFrame:
    """key, total, correct, substitutions, deleted, inserted: how a proposal fares against what was confirmed."""
    n = pairs.select(key, counted_tokens(F.col(proposed), F.col(confirmed)).alias("x"))
    return n.groupBy(key).agg(*[F.sum(f"x.{c}").alias(c) for c in _COUNTS]).where("total > 0")
