"""Substring deduplication by collinear chaining.

1. Seeds: the text's words are rolled into k-mers. By default each is a seed: of 40 words or more with 80 % equal, the others replaced,
   some 4 successive ones are equal. With a higher `rate` one in so many is, chosen by its hash. Besides, of every 9 successive runs of `least` - 8 words the one with the smallest hash is a seed, so
   any two equal runs of `least` words share one.
2. Join: equal seeds meet (see meeting.py). Each occurrence is matched with the corpus' first: the smallest document that has the seed,
   and the earliest place in it. A passage in n documents so makes about n matches, not n^2. Which documents come in one batch or
   partition decides nothing. The seeds of a passage may stand first in different documents; the long seeds see to it that a document
   that repeats a run of `least` words is linked to one that holds most of it at least. Around matched long seeds the runs of `least`
   words themselves meet, so it is linked to the first one that holds all of it, too (where a document has a long seed twice, around its earliest place only if it is the seed's first).
   A seed that is frequent within a batch is sent once from it; its other occurrences there wait as rows of their own for what the one
   is matched with, so however hot a seed is, no bucket gets more than a few occurrences a batch.
3. Chain: the matches of a pair of documents, joined to anchors along their diagonals, are chained by their order in both texts. The
   best chain that ends in an anchor is its length plus the best over all anchors that end before it in both texts and no more than
   `jump` words away, less a cost for the words skipped in either: with a tree of maxima over one text's positions, n log n steps.
   Every pair goes on; those with short chains only are first probed on the words around them, a byte each.
4. Align: chains are aligned on the whole texts' words. Anchors are compared word by word, the words between them by their longest
   common subsequence, and the ends are extended while that pays. A passage counts if it has `least` words and enough equal ones; a
   chain that has too few as a whole is cut into its longest stretches that have enough.

Defined cases. Null, empty and short texts have no passages. Rows without an id take no part; rows that share an id are one document,
which isn't matched with itself. Ties go to the smaller id and the earlier place. Passages that stand twice in the document that has
them first are found in the other documents only. Other columns are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import meeting
from textloom.llm.storage import dropped, small_batches, written

K, RATE, LEAST, EQUAL, JUMP, GAP_COST, REACH, AROUND = 4, 1, 40, 0.8, 30, 0.05, 400, 60
#: Successive long runs of which one is a seed; occurrences of a seed that a batch sends by themselves.
WINDOW, FREQUENT = 9, 32



def sampled(h: np.ndarray, rate: int) -> np.ndarray:
    """Places of the k-mers that are seeds."""
    return np.arange(len(h)) if rate == 1 else np.flatnonzero((h >> np.uint64(20)) % np.uint64(rate) == 0)


def minimizers(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest of every `window` successive hashes; of all, if there are fewer."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= window:
        return np.array([h.argmin()])
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, window).argmin(1) + np.arange(len(h) - window + 1))


def seeds(words: np.ndarray, cuts: np.ndarray, k: int, rate: int, least: int):
    """For each text hashes and places (of the first word) of its seeds. The long ones are told apart by an odd place count: place * 2 + 1."""
    long = max(1, least - WINDOW + 1)
    sizes = np.diff(cuts)
    for n, short, runs in zip(sizes.tolist(), meeting.rolled_texts(words, cuts, k), meeting.rolled_texts(words, cuts, long), strict=True):
        at = sampled(short, rate) if n >= k else np.zeros(0, np.int64)
        of_long = minimizers(runs) if n >= long else np.zeros(0, np.int64)
        yield np.concatenate([short[at], runs[of_long]]), np.concatenate([at * 2, of_long * 2 + 1])


def first_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by token, equal ones as they come; in it each run's first (a place for each), and the run's length."""
    order = np.argsort(tokens, kind="stable")
    cuts = meeting.starts_of(tokens[order])
    size = np.diff(cuts)
    return order, np.repeat(cuts[:-1], size), np.repeat(size, size)


def matches(docs: DataFrame, k: int, rate: int, least: int, buckets: int, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """doc, place, source, source_place, long: each seed's occurrence and the corpus' first, where these are two documents; and the written table that this reads."""
    import pyarrow as pa

    names = ["doc", "place", "source", "source_place"]

    def rows_of(doc, place, source, source_place, waits, asked):
        return pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in zip(names, (doc, place, source, source_place), strict=True)} | {"waits": pa.array(np.full(len(doc), waits)), "asked": pa.array(asked)})

    def sending(batches):
        empty = lambda n: pa.array([b""] * n, pa.binary())
        for b in meeting.slices(batches, 1000):
            b = b.sort_by("doc_id")  # so that equal seeds come by document and place
            found = list(seeds(*meeting.hashed_words(b.column(1)), k, rate, least))
            sizes = [len(h) for h, _ in found]
            if not sum(sizes):
                continue
            tokens = np.concatenate([h for h, _ in found]) & np.uint64((1 << 48) - 1)
            place = np.concatenate([at for _, at in found])
            doc = np.repeat(b.column(0).to_numpy(), sizes)
            order, first, size = first_of(tokens)
            waits, asked = np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
            waits[order] = (size > frequent) & (first != np.arange(len(order)))
            asked[order] = (size > frequent) & (first == np.arange(len(order)))
            sent = ~waits
            out = meeting.packed(tokens[sent], {"doc": doc[sent].astype("<i8"), "place": (place[sent] | asked[sent] << 31).astype("<u4")}, buckets)
            yield pa.RecordBatch.from_arrays([*out.columns, empty(out.num_rows), empty(out.num_rows)], names=["bucket", "lo", "hi", *names])
            doc, place = doc[order], place[order]
            at = np.flatnonzero(waits[order])
            for lo in range(0, len(at), 50_000):  # rows below bucket 0, a few documents in each
                some = at[lo : lo + 50_000]
                cells = [pa.array([v.astype("<i8").tobytes()], pa.binary()) for v in (doc[some], place[some], doc[first[some]], place[first[some]])]
                yield pa.RecordBatch.from_arrays([pa.array([-1 - (int(doc[some[0]]) + lo) % buckets], pa.int32()), empty(1), empty(1), *cells], names=["bucket", "lo", "hi", *names])

    def meeting_up(batches):
        rows = []
        for b in batches:
            waiting = b.column(0).to_numpy() < 0
            for i in np.flatnonzero(waiting):
                yield rows_of(*[np.frombuffer(b.column(3 + j)[int(i)].as_py(), "<i8") for j in range(4)], True, np.zeros(len(b.column(3)[int(i)].as_py()) // 8, bool))
            rows.append(b.filter(pa.array(~waiting)))
        if (all_ := meeting.met(rows, {"doc": "<i8", "place": "<u4"})) is None:
            return
        tokens, more = all_
        # most seeds come once: leave them before the full sort
        order, _, size = first_of(tokens)
        some = order[size > 1]
        # the highest bit of a place: others wait for it
        tokens, doc, place, asked = tokens[some], more["doc"][some], more["place"][some].astype(np.int64) & ((1 << 31) - 1), more["place"][some] >> 31 == 1
        # a seed's first: its smallest document, and the earliest place in that
        cuts = meeting.starts_of(tokens) if len(tokens) else np.zeros(1, np.int64)
        begin, size = cuts[:-1], np.diff(cuts)
        source = np.repeat(np.minimum.reduceat(doc, begin), size) if len(doc) else doc
        source_place = np.repeat(np.minimum.reduceat(np.where(doc == source, place, 1 << 40), begin), size) if len(doc) else place
        at = np.flatnonzero(doc != source)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield rows_of(doc[part], place[part], source[part], source_place[part], False, asked[part])
        del rows, all_, tokens, more, some, order, doc, place, asked, source, source_place
        meeting.released()

    rows = docs.where("doc_id is not null").mapInArrow(sending, meeting.schema(names))
    met = written(meeting.dealt(rows, buckets).mapInArrow(meeting_up, ", ".join(f"{n} long" for n in names) + ", waits boolean, asked boolean"), "met")
    settled, waiting = met.where("not waits"), met.where("waits").select(*names)
    if not waiting.isEmpty():
        # a waiting row's source is the first of its batch; that one's match, if it has one, is the corpus' first
        known = settled.where("asked").select(F.col("doc").alias("source"), F.col("place").alias("source_place"), F.col("source").alias("s"), F.col("source_place").alias("p"))
        late = waiting.join(known, ["source", "source_place"], "left").select("doc", "place", F.coalesce("s", "source").alias("source"), F.coalesce("p", "source_place").alias("source_place")).where("doc <> source")
        settled = settled.select(*names).unionByName(late)
    # places are doubled and odd for long seeds (see seeds); both kinds may match the same place
    return settled.select("doc", F.floor(F.col("place") / 2).alias("place"), "source", F.floor(F.col("source_place") / 2).alias("source_place"), (F.col("place") % 2 == 1).alias("long")), met


def whole_runs(docs: DataFrame, found: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """doc, place, source, source_place, long: the runs of `least` words around matched long seeds, each matched with the first document that has all of it. Only such runs can repeat, as two equal ones share a long seed. And the written table that this reads."""
    import pyarrow as pa

    wide = max(0, least - max(1, least - WINDOW + 1))
    shared = found.where("long")
    at = shared.select(F.col("doc").alias("doc_id"), "place").union(shared.select("source", "source_place")).groupBy("doc_id").agg(F.array_distinct(F.collect_list("place")).alias("places"))

    def hashing(batches):
        for b in meeting.slices(batches, 250):
            words, cuts = meeting.hashed_words(b.column(1))
            for doc, places, lo, hi in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo < least:
                    continue
                h = meeting.rolled(words[lo:hi], least)
                begins = np.unique((np.array(places)[:, None] - np.arange(wide + 1)).ravel())
                begins = begins[(begins >= 0) & (begins < len(h))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begins), doc), pa.int64()), pa.array(begins, pa.int64()), pa.array(h[begins].view(np.int64))], names=["doc", "place", "h"])

    runs = docs.where("doc_id is not null").join(at, "doc_id").select("doc_id", F.col("text").alias("text"), "places").mapInArrow(hashing, "doc long, place long, h long")

    def matching(batches):
        """Of sorted runs the first of each hash, which the others are matched with; a hash may go on in the next batch, so a hot one takes no more memory."""
        last = None  # the hash the batch before ended with, and its first
        for b in batches:
            doc, place, h = (c.to_numpy() for c in b.columns)
            if not len(h):
                continue
            cuts = meeting.starts_of(h)
            size = np.diff(cuts)
            source, source_place = doc[cuts[:-1]], place[cuts[:-1]]
            if last is not None and last[0] == h[0]:
                source[0], source_place[0] = last[1:]
            last = int(h[-1]), int(source[-1]), int(source_place[-1])
            source, source_place = np.repeat(source, size), np.repeat(source_place, size)
            other = doc != source
            yield pa.RecordBatch.from_arrays([pa.array(v[other], pa.int64()) for v in (doc, place, source, source_place)], names=["doc", "place", "source", "source_place"])

    # rows that share an id may repeat a match; chaining takes it once
    met = runs.repartition("h").sortWithinPartitions("h", "doc", "place").mapInArrow(matching, "doc long, place long, source long, source_place long")
    met = written(met, "runs")
    return met.withColumn("long", F.lit(True)), met


class Fenwick:
    """Prefix maxima, and where they were set."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, value: float, which: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, which)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The maximum over places before i."""
        found = (-np.inf, -1)
        while i > 0:
            if self.best[i][0] > found[0]:
                found = self.best[i]
            i -= i & -i
        return found


class Maxima:
    """Values of n places, of which the greatest between two places is asked for."""

    def __init__(self, n: int):
        self.n, self.best = n, [(-np.inf, -1)] * (2 * n)

    def put(self, i: int, value: float, which: int) -> None:
        i += self.n
        self.best[i] = (value, which)
        while i > 1:
            i >>= 1
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def within(self, lo: int, hi: int) -> tuple[float, int]:
        """The maximum over lo <= place < hi."""
        found, lo, hi = (-np.inf, -1), lo + self.n, hi + self.n
        while lo < hi:
            if lo & 1:
                found = max(found, self.best[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                found = max(found, self.best[hi])
            lo, hi = lo >> 1, hi >> 1
        return found


def chains(anchors: list[tuple[int, int, int]], cost: float = GAP_COST, jump: int = JUMP) -> list[list[tuple[int, int, int]]]:
    """From anchors (x, y, words; x and y: first words in both texts), chains that rise in both, best first, without shared anchors."""
    n = len(anchors)
    if n == 1:
        return [anchors]
    rank = sorted(range(n), key=lambda i: anchors[i][1] + anchors[i][2])
    ends = [anchors[i][1] + anchors[i][2] for i in rank]
    at_end = {i: r for r, i in enumerate(rank)}
    # an anchor may follow those that end at or up to `jump` before its start: in the tree while x is that near, asked for by y
    opening = sorted(range(n), key=lambda i: (anchors[i][0], anchors[i][1]))
    closing = sorted(range(n), key=lambda i: anchors[i][0] + anchors[i][2])
    tree, score, before, done, gone = Maxima(n), [0.0] * n, [-1] * n, 0, 0
    for i in opening:
        x, y, w = anchors[i]
        while done < n and anchors[closing[done]][0] + anchors[closing[done]][2] <= x:
            j = closing[done]
            xj, yj, wj = anchors[j]
            tree.put(at_end[j], score[j] + cost * (xj + wj + yj + wj), j)
            done += 1
        while gone < done and anchors[closing[gone]][0] + anchors[closing[gone]][2] < x - jump:
            tree.put(at_end[closing[gone]], -np.inf, -1)
            gone += 1
        best, j = tree.within(bisect_left(ends, y - jump), bisect_right(ends, y))
        gain = best - cost * (x + y)
        score[i] = w + max(0.0, gain)
        if gain > 0:
            before[i] = j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], anchors[i])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(anchors[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Of the longest common subsequence: a word of `a` at a time, all of `b` as the bits of one number."""
    masks: dict[int, int] = {}
    for j, y in enumerate(b.tolist()):
        masks[y] = masks.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every  # the zeros are where the length grows
    for x in a.tolist():
        if common := row & masks.get(x, 0):
            row = ((row + common) | (row - common)) & every
    return len(b) - row.bit_count()


def equal_words(a: np.ndarray, b: np.ndarray, run: int = 8, piece: int = 1000) -> int:
    """Of two stretches of the same length that agree word by word for the most part: where they don't, words shifted against each other
    count as well. Unequal places with fewer than `run` equal words between them are aligned together, long ones in pieces."""
    unequal = np.flatnonzero(a != b)
    if not len(unequal):
        return len(a)
    cuts = np.flatnonzero(np.diff(unequal) > run)
    total = len(a)
    for lo, hi in zip(unequal[np.concatenate([[0], cuts + 1])], unequal[np.concatenate([cuts, [len(unequal) - 1]])] + 1, strict=True):
        total -= hi - lo
        if hi - lo > 1:
            total += sum(common_length(a[i : min(i + piece, hi)], b[i : min(i + piece, hi)]) for i in range(lo, hi, piece))
    return int(total)


def extension(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two texts that begin here agree: words, and equal ones among them; equal +1, unequal -2, as far as the sum is greatest."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -2))
    low = np.flatnonzero(np.maximum.accumulate(total) - total > 12)
    if len(low):
        total = total[: low[0]]
    far = int(total.argmax()) + 1 if len(total) and total.max() > 0 else 0
    return far, int(same[:far].sum())


#: Words that an extension may skip in either text, and what equal words behind must be worth it.
SKIPS, WORTH = ((1, 0), (0, 1), (2, 0), (0, 2)), 5


def extended(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[int, int, int, list[tuple[int, int, int]]]:
    """How far two texts that begin here agree, a few words put in or left out allowed: words in both, equal ones, and the runs compared
    word by word (begin in both, words)."""
    x = y = equal = 0
    runs = []
    while True:
        far, same = extension(a[x : x + reach], b[y : y + reach])
        runs.append((x, y, far))
        x, y, equal = x + far, y + far, equal + same
        if far == reach:
            continue
        found = max(((extension(a[x + i : x + i + reach], b[y + j : y + j + reach]), -i - j, i, j) for i, j in SKIPS), key=lambda f: (f[0][1], f[1]))
        if found[0][1] < WORTH:
            return x, y, equal, runs
        x, y = x + found[2], y + found[3]


#: Columns of which most extensions need no more.
NARROW = 64


class Words:
    """The words of several texts, one behind the other, and where each begins (and the end)."""

    def __init__(self, texts: list[np.ndarray]):
        self.cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.all = np.concatenate([*texts, np.zeros(1, texts[0].dtype if texts else np.uint8)])  # one more, so that any place can be read


def extensions(a: np.ndarray, at: np.ndarray, n: np.ndarray, b: np.ndarray, bt: np.ndarray, m: np.ndarray, step: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """`extension` for many pairs of texts: from place `at` of a, of which n words are left, and `bt` of b, forwards (step 1) or backwards (-1)."""
    far, equal = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    left = np.minimum(np.minimum(n, m), reach)
    some, width = np.flatnonzero(left > 0), min(NARROW, reach)
    while len(some):
        j = np.arange(width)
        inside = j < left[some, None]
        same = (a[np.where(inside, at[some, None] + step * j, -1)] == b[np.where(inside, bt[some, None] + step * j, -1)]) & inside
        total = np.cumsum(np.where(same, np.int32(1), np.int32(-2)), 1, dtype=np.int32)  # words behind the end count as unequal: never the greatest sum
        ended = np.logical_or.accumulate(np.maximum.accumulate(total, 1) - total > 12, 1)
        total[ended] = -(1 << 30)
        best = total.argmax(1)
        most = total[np.arange(len(some)), best]
        far[some] = np.where(most > 0, best + 1, 0)
        equal[some] = np.where(most > 0, (most + 2 * (best + 1)) // 3, 0)
        some, width = some[~ended[:, -1] & (left[some] > width)], reach
    return far, equal


def all_extended(a: np.ndarray, at: np.ndarray, n: np.ndarray, b: np.ndarray, bt: np.ndarray, m: np.ndarray, step: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`extended` for many pairs of texts, without the runs."""
    x, y, equal = (np.zeros(len(at), np.int64) for _ in range(3))
    some = np.arange(len(at))
    while len(some):
        ask = lambda i, j, which: extensions(a, at[which] + step * (x[which] + i), n[which] - x[which] - i, b, bt[which] + step * (y[which] + j), m[which] - y[which] - j, step, reach)
        far, same = ask(0, 0, some)
        x[some] += far
        y[some] += far
        equal[some] += same
        stopped = some[far < reach]
        skips = np.stack([ask(i, j, stopped)[1] for i, j in SKIPS])
        best = skips.argmax(0)  # SKIPS begins with those that leave out least
        on = skips.max(0) >= WORTH
        x[stopped[on]] += np.array(SKIPS)[best[on], 0]
        y[stopped[on]] += np.array(SKIPS)[best[on], 1]
        some = np.concatenate([some[far == reach], stopped[on]])
    return x, y, equal


def ends(a: Words, ai: np.ndarray, b: Words, bi: np.ndarray, x0: np.ndarray, y0: np.ndarray, px: np.ndarray, py: np.ndarray, reach: int) -> tuple[tuple, tuple]:
    """How far chains from (x0, y0) to (px, py) in texts number ai and bi are extended forwards and backwards: words in both, equal ones."""
    a0, b0 = a.cuts[ai], b.cuts[bi]
    forward = all_extended(a.all, a0 + px, a.cuts[ai + 1] - a0 - px, b.all, b0 + py, b.cuts[bi + 1] - b0 - py, 1, reach)
    return forward, all_extended(a.all, a0 + x0 - 1, x0, b.all, b0 + y0 - 1, y0, -1, reach)


def inner(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray) -> int:
    """The equal words from a chain's first anchor to its last."""
    px, py, equal = chain[0][0], chain[0][1], 0
    for x, y, w in chain:
        equal += common_length(a[px:x], b[py:y]) + equal_words(a[x : x + w], b[y : y + w])
        px, py = x + w, y + w
    return equal


def align(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray, reach: int = REACH) -> tuple[int, int, int, int, int]:
    """Begin and end in both texts, and the number of equal words."""
    (x0, y0, _), (x, y, w) = chain[0], chain[-1]
    one = lambda v: np.array([v])
    (fx, fy, same), (bx, by, more) = ends(Words([a]), one(0), Words([b]), one(0), one(x0), one(y0), one(x + w), one(y + w), reach)
    return int(x0 - bx[0]), int(x + w + fx[0]), int(y0 - by[0]), int(y + w + fy[0]), inner(chain, a, b) + int(same[0] + more[0])


def common_places(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of a longest common subsequence: its places in both."""
    rows, shared = [np.zeros(len(b) + 1, np.int32)], np.isin(a, b)
    if not shared.any():
        return []
    for x, there in zip(a, shared, strict=True):
        if not there:
            rows.append(rows[-1])
            continue
        up = np.where(b == x, rows[-1][:-1] + 1, rows[-1][1:])
        rows.append(np.concatenate([[0], np.maximum.accumulate(up)]).astype(np.int32))
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def equal_places(a: np.ndarray, b: np.ndarray, run: int = 8, piece: int = 1000) -> list[tuple[int, int]]:
    """The places of what equal_words counts."""
    same = a == b
    unequal, out = np.flatnonzero(~same), []
    if len(unequal):
        cuts = np.flatnonzero(np.diff(unequal) > run)
        for lo, hi in zip(unequal[np.concatenate([[0], cuts + 1])], unequal[np.concatenate([cuts, [len(unequal) - 1]])] + 1, strict=True):
            same[lo:hi] = False
            for i in range(int(lo), int(hi), piece):
                out += [(i + u, i + v) for u, v in common_places(a[i : min(i + piece, hi)], b[i : min(i + piece, hi)])]
    return sorted(out + [(i, i) for i in np.flatnonzero(same).tolist()])


def places(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray, reach: int = REACH) -> list[tuple[int, int]]:
    """The places of the equal words that align counts."""
    x0, y0, _ = chain[0]
    px, py = x0, y0
    found = [(x0 - 1 - x - i, y0 - 1 - y - i) for x, y, far in extended(a[:x0][::-1], b[:y0][::-1], reach)[3] for i in range(far)][::-1]
    found = [(x, y) for x, y in found if a[x] == b[y]]
    for x, y, w in chain:
        found += [(px + i, py + j) for i, j in common_places(a[px:x], b[py:y])] + [(x + i, y + j) for i, j in equal_places(a[x : x + w], b[y : y + w])]
        px, py = x + w, y + w
    return found + [(px + x + i, py + y + i) for x, y, far in extended(a[px:], b[py:], reach)[3] for i in range(far) if a[px + x + i] == b[py + y + i]]


def cut(found: list[tuple[int, int]], least: int, share: float) -> list[tuple[int, int]]:
    """From the places of equal words, rising in both texts: the longest stretches (first and last of the places) of `least` words with
    `share` of them equal in both texts; of those that overlap, as few as hold every place that is in any."""
    n, slack = len(found), 1e-6
    if n < share * least - slack:
        return []
    at, xy = np.arange(n), np.array(found)
    # i..j has enough equal words where end[j] >= begin[i] in both texts
    begin, end = at[:, None] - share * xy - slack, at[:, None] + 1 - share * (xy + 1)
    ranked = np.sort(-end[:, 1])
    place, upto = np.searchsorted(ranked, -end[:, 1]).tolist(), np.searchsorted(ranked, -begin[:, 1], side="right").tolist()
    tree, far, done, ends = Fenwick(n), [-1] * n, 0, np.argsort(-end[:, 0], kind="stable").tolist()
    for i in np.argsort(-begin[:, 0], kind="stable").tolist():
        while done < n and end[ends[done], 0] >= begin[i, 0]:
            tree.put(place[ends[done]], ends[done], ends[done])
            done += 1
        far[i] = tree.upto(upto[i])[1]
    good = [i for i in range(n) if far[i] >= i and max(found[far[i]][0] - found[i][0], found[far[i]][1] - found[i][1]) + 1 >= least]
    out, covered, i = [], -1, 0
    while i < len(good):
        best = good[i]
        i += 1
        while i < len(good) and good[i] <= covered:
            best = max(best, good[i], key=far.__getitem__)
            i += 1
        if far[best] > covered:
            out.append((best, far[best]))
            covered = far[best]
    return out


def stretches(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray, least: int, equal: float, whole: tuple[int, int, int, int, int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """The passages of a chain, as align gives them (`whole`, if that is known): the whole, if enough of it is equal, else its longest stretches that are."""
    x0, x1, y0, y1, same = whole = whole or align(chain, a, b)
    words = max(x1 - x0, y1 - y0)
    if words < least or same >= equal * words:
        return [whole] if words >= least else []
    if same < equal * least:
        return []
    found = places(chain, a, b)
    return [(found[i][0], found[j][0] + 1, found[i][1], found[j][1] + 1, j - i + 1) for i, j in cut(found, least, equal)]


def chained(found: DataFrame, k: int, long: int, jump: int) -> DataFrame:
    """From matches: doc, source and their chains (a chain: its anchors' x, y, words in a row). k and long: the words of the two kinds of seeds."""
    import pyarrow as pa

    def anchored(doc, source, place, source_place, size):
        """Runs of matches along a diagonal, no further apart than jump, as anchors; rows come sorted by doc, source, diagonal, place."""
        diagonal = place - source_place
        same = np.zeros(len(doc), bool)
        same[1:] = (doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & (diagonal[1:] == diagonal[:-1])
        # how far the matches so far reach on their diagonal, told on one line for all diagonals
        number = np.cumsum(~same)
        span = int(place.max()) + long + jump + 1
        reach = np.maximum.accumulate(number * span + place + size)
        new = ~same
        new[1:] |= number[1:] * span + place[1:] - reach[:-1] > jump
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(doc)]]) - 1
        x, y, w = place[first], source_place[first], reach[last] - number[last] * span - place[first]
        d, s = doc[first], source[first]
        pair = np.ones(len(d), bool)
        pair[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
        cuts = np.concatenate([np.flatnonzero(pair), [len(d)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            found = chains(list(zip(x[lo:hi].tolist(), y[lo:hi].tolist(), w[lo:hi].tolist(), strict=True)), jump=jump)
            yield int(d[lo]), int(s[lo]), [[v for a in c for v in a] for c in found]

    def out(rows):
        return pa.RecordBatch.from_pydict({"doc": pa.array([r[0] for r in rows], pa.int64()), "source": pa.array([r[1] for r in rows], pa.int64()), "chains": pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int64())))})

    def chaining(batches):
        rest = None
        for b in batches:
            part = [c.to_numpy() for c in b.columns]
            if rest is not None:
                part = [np.concatenate([r, p]) for r, p in zip(rest, part, strict=True)]
            # the last pair may go on in the next batch
            last = np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = [p[cut:] for p in part]
            if cut and (rows := list(anchored(*[p[:cut] for p in part]))):
                yield out(rows)
        if rest is not None and len(rest[0]) and (rows := list(anchored(*rest))):
            yield out(rows)

    # by diagonal, then by place, as one number
    along = (F.col("place") - F.col("source_place")) * F.lit(1 << 32) + F.col("place")
    dealt = found.repartition("doc", "source").sortWithinPartitions("doc", "source", along)
    return dealt.select("doc", "source", "place", "source_place", F.when(F.col("long"), long).otherwise(k).cast("long").alias("size")).mapInArrow(chaining, "doc long, source long, chains array<array<long>>")


def hopeful(a: Words, b: Words, before: np.ndarray, after: np.ndarray, span: np.ndarray, least: int, around: int = AROUND) -> np.ndarray:
    """From the words (a byte each) around chains of `span` words, a pair of texts for each, of which `before` (in both) stand before it and from `after` on behind it: may it be extended to `least` words?"""
    each = np.arange(len(span))
    (fx, fy, _), (bx, by, _) = ends(a, each, b, each, *before, *after, around)
    f, g = np.maximum(fx, fy), np.maximum(bx, by)
    return (f * 2 >= around) | (g * 2 >= around) | (span + f + g >= least)


def promising(pairs: DataFrame, docs: DataFrame, least: int, around: int = AROUND) -> DataFrame:
    """The pairs that may have a passage: all with a chain of half its length, and of the others those with a chain that can be extended.
    That is told from the words around the chains, a byte each, so that pairs with a chance seed don't carry two texts."""
    import pyarrow as pa

    span = lambda c: F.get(c, F.size(c) - 3) + F.get(c, F.size(c) - 1) - F.get(c, F.lit(0))
    long = F.exists("chains", lambda c: 2 * span(c) >= least)
    faint = pairs.where(~long).select("doc", "source", F.explode("chains").alias("c"))
    n = F.size("c")
    ends = faint.select("doc", "source", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y"), (F.get("c", n - 3) + F.get("c", n - 1)).alias("px"), (F.get("c", n - 2) + F.get("c", n - 1)).alias("py"))
    key = ["doc", "source", "x", "y", "px", "py"]
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("doc").alias("doc_id"), F.col("x").alias("lo"), F.col("px").alias("hi")), F.struct(F.lit(1).alias("side"), F.col("source").alias("doc_id"), F.col("y").alias("lo"), F.col("py").alias("hi")))
    asked = ends.select(*key, F.explode(sides).alias("s")).select(*key, "s.*")

    def reading(batches):
        for b in meeting.slices(batches):
            words, cuts = meeting.hashed_words(b.column(1))
            words = (words & np.uint64(255)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words[x:z] for x, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["doc_id", "words"])

    begin = F.greatest(F.lit(0).cast("long"), F.col("lo") - around)
    told = docs.where("doc_id is not null").mapInArrow(reading, "doc_id long, words binary")
    around_ = asked.join(told, "doc_id").select(*key, "side", F.substring("words", (begin + 1).cast("int"), (F.col("hi") + around - begin).cast("int")).alias("words"))
    both = around_.groupBy(*key).agg(*[F.collect_set(F.when(F.col("side") == i, F.col("words"))).alias(n) for i, n in enumerate("ab")])  # several, where texts share an id

    def probing(batches):
        for batch in meeting.slices(batches, 1000):
            doc, source, x, y, px, py = (c.to_numpy() for c in batch.columns[:6])
            tries = [(i, np.frombuffer(u, np.uint8), np.frombuffer(v, np.uint8)) for i, (us, vs) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)) for u in us for v in vs]
            at = np.array([i for i, _, _ in tries], int)
            before = np.minimum(x, around)[at], np.minimum(y, around)[at]
            after = before[0] + (px - x)[at], before[1] + (py - y)[at]
            good = at[hopeful(Words([u for _, u, _ in tries]), Words([v for _, _, v in tries]), np.stack(before), np.stack(after), np.maximum(px - x, py - y)[at], least, around)]
            rows = sorted(set(zip(doc[good].tolist(), source[good].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], names=["doc", "source"])

    found = both.mapInArrow(probing, "doc long, source long").distinct()
    return pairs.where(long).unionByName(pairs.where(~long).join(found, ["doc", "source"], "left_semi"))


def aligned(pairs: DataFrame, docs: DataFrame, least: int, equal: float) -> DataFrame:
    import pyarrow as pa

    ids = pairs.select(F.col("doc").alias("doc_id")).union(pairs.select("source")).distinct()
    texts = meeting.sought(docs, ids, "doc_id")
    both = pairs.join(texts.select(F.col("doc_id").alias("doc"), F.col("text").alias("a")), "doc").join(texts.select(F.col("doc_id").alias("source"), F.col("text").alias("b")), "source").select("doc", "source", "chains", "a", "b")

    def aligning(batches):
        kept: dict[str, np.ndarray] = {}

        def of(texts):
            """Hashed words, those of the last texts kept: a document's pairs come together."""
            new = list({t for t in texts if t not in kept})
            if len(kept) + len(new) > 128:
                new = list(set(texts))
                kept.clear()
            words, cuts = meeting.hashed_words(pa.array(new, pa.large_string()))
            kept.update((t, words[x:z].copy()) for t, x, z in zip(new, cuts[:-1], cuts[1:], strict=True))

        for batch in meeting.slices(batches, 50):
            rows, left, right = set(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            of([t or "" for t in left + right])
            texts = {t: i for i, t in enumerate(dict.fromkeys(t or "" for t in left + right))}
            words = Words([kept[t] for t in texts])
            ask = []
            for doc, source, found, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), left, right, strict=True):
                for flat in found:
                    chain = [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
                    if chain[-1][0] + chain[-1][2] <= len(kept[ta or ""]) and chain[-1][1] + chain[-1][2] <= len(kept[tb or ""]):  # else another text under the same id
                        ask.append((doc, source, chain, ta or "", tb or ""))
            for lo in range(0, len(ask), 500):
                some = ask[lo : lo + 500]
                x0, y0 = (np.array([c[2][0][i] for c in some]) for i in range(2))
                px, py = (np.array([c[2][-1][i] + c[2][-1][2] for c in some]) for i in range(2))
                of_a, of_b = (np.array([texts[c[i]] for c in some]) for i in (3, 4))
                (fx, fy, after), (bx, by, before) = ends(words, of_a, words, of_b, x0, y0, px, py, REACH)
                x0, px, y0, py = x0 - bx, px + fx, y0 - by, py + fy
                for i in np.flatnonzero(np.maximum(px - x0, py - y0) >= least).tolist():
                    doc, source, chain, ta, tb = some[i]
                    a, b = kept[ta], kept[tb]
                    whole = int(x0[i]), int(px[i]), int(y0[i]), int(py[i]), inner(chain, a, b) + int(after[i] + before[i])
                    for x, x1, y, y1, same in stretches(chain, a, b, least, equal, whole):
                        n = max(x1 - x, y1 - y)
                        rows.add((doc, x, x1, source, y, y1, n, same / n))
            names = ("doc_id", "begin", "end", "source_id", "source_begin", "source_end", "words")
            columns = list(zip(*sorted(rows), strict=True)) or [()] * 8
            yield pa.RecordBatch.from_pydict({n: pa.array(columns[i], pa.int64()) for i, n in enumerate(names)} | {"equal": pa.array(columns[7], pa.float64())})

    return both.mapInArrow(aligning, "doc_id long, begin long, end long, source_id long, source_begin long, source_end long, words long, equal double")


def passages(docs: DataFrame, k: int = K, rate: int = RATE, least: int = LEAST, equal: float = EQUAL, jump: int = JUMP, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin, end (words of the repeated passage, from 0), source_id, source_begin, source_end (where it stands before), words, equal (share of equal words)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    words, long = int(size) // 6, max(1, least - WINDOW + 1)
    found, met = matches(docs, k, rate, least, meeting.buckets_for(words // rate + words * 2 // (WINDOW + 1)), frequent)
    more, runs = whole_runs(docs, found, least)
    pairs = written(chained(found.unionByName(more), k, long, jump), "chains")
    dropped(met)
    dropped(runs)
    likely = written(promising(pairs, docs, least), "promising")
    dropped(pairs)
    return aligned(likely, docs, least, equal)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
