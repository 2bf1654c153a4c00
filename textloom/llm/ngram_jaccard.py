r"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.75 or more. The join is exact: no sampling, no
caps, and what prefixes find is verified on the whole texts. Results are components, so copies and near copies need not be expanded
into all pairs.

1. Documents with equal sets (a 128-bit hash of the sorted set) form a class; its smallest id stands for it from here on.
2. Near copies are merged cheaply: classes that share a key of two minimum hashes are compared with the smallest one of that key (a
   star, not all pairs). Verified links form first components; a further round with other keys compares only what is apart still. This
   step only saves work, step 3 finds whatever it misses.
3. The join. All shingles have one global order: common ones last, otherwise by hash. A document's prefix are its first P + l - 1
   shingles in that order, P = n - ceil(0.75 n) + 1, and two linking documents share at least min(l, l') shingles of their prefixes.
   Each document sends a stretch of its smallest hashes, longer than P. Shingles of more than HOT documents in two components or more
   are common; how many of them lie in a document's stretch is the cost it would have; they leave its prefix, and l is what remains
   over. Documents with too few left (l < 1, and with them those that are close to it) get a longer stretch: all their shingles.
   Shingles that lie in one component only are dropped: nothing is left to find there. The others' documents, at most HOT a shingle, are
   paired when their components differ and their sizes allow 0.75, and pairs with fewer shared prefix shingles than required are dropped.
   So two families of near copies that share passages, but less than three quarters, are never paired document by document: the
   passages are common, and what is left of the prefixes is each family's own.
   Documents that consist of common shingles only (l < 1 though all are sent) can miss each other only; they are joined among
   themselves, the rarest shingles first, with prefixes cut where a first shared shingle would come too late for 0.75 (see among).
4. The pairs are verified on sorted arrays of the whole texts' shingles. Pairs are dealt in blocks of documents that have pairs among
   each other, so an array travels once a block and not once a pair.
5. Components of all links.

Hot shingles are no one's burden: a batch sends at most HOT + 2 documents of a shingle, which marks it as common, and counts the rest
at once (as common; if it lies in one component only, that asks more of a document than needed, never less). Stars and labels are
aggregations and equi-joins on keys dealt anew, which adaptive execution splits.

Defined cases. Null text counts as empty; empty documents and those without words have no shingles and link with nothing. Fewer than
five words: the whole sequence is one shingle. Rows without an id are returned with component null. Rows that share an id are one
document: linked. Other columns are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import meeting
from textloom.llm.components import components
from textloom.llm.storage import dropped, small_batches, written

WIDTH, PERCENT, HOT, KEYS, ROUNDS = 5, 75, 32, 8, 2
#: Shingles of a block of documents that are verified together, about.
UNIT = 100_000
_rng = np.random.default_rng(2024)
_MULTIPLIERS = _rng.integers(1, 1 << 63, 2 * KEYS * ROUNDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEY_COLS = [f"key{i}" for i in range(KEYS * ROUNDS)]


def shingle_sets(column, width: int = WIDTH):
    """For each text of an Arrow column the sorted set of its shingles' hashes."""
    for h in meeting.rolled_texts(*meeting.hashed_words(column), width):
        h = np.sort(h)
        yield h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def prefix(n, percent: int):
    """n - ceil(percent n / 100) + 1, of numbers or columns' SQL."""
    return n - (percent * n + 99) // 100 + 1


def stretch(n: int, percent: int) -> int:
    return min(n, prefix(n, percent) * 6 // 5 + 6)


def _packed48(h: np.ndarray) -> bytes:
    return (h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _unpacked48(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, "<u4", n).astype(np.uint64) | np.frombuffer(b, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def minima(h: np.ndarray) -> np.ndarray:
    """The keys: each mixed from the set's minima under two multiplications."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(h), 20_000):  # so that a very long text takes no more memory
            least = np.minimum(least, (h[lo : lo + 20_000] * _MULTIPLIERS[:, None]).min(1))
        return meeting.mixed(least[::2] * np.uint64(31) + least[1::2] + np.arange(len(KEY_COLS), dtype=np.uint64)).view(np.int64)


def sketch(docs: DataFrame, width: int, percent: int, whole: bool = False) -> DataFrame:
    """doc_id, n, sig (of the set), the keys, and the packed stretch (48 bits a shingle: equal shingles stay equal)."""
    import pyarrow as pa
    import xxhash

    def sketched(batches):
        for batch in meeting.slices(batches):
            n, sig, sent, keys = [], [], [], []
            for h in shingle_sets(batch.column(1), width):
                n.append(len(h))
                sig.append(xxhash.xxh3_128_digest(h.tobytes()))
                sent.append(_packed48(h if whole else h[: stretch(len(h), percent)]))
                if not whole:
                    keys.append(minima(h))
            by_key = np.array(keys).reshape(-1, len(KEY_COLS))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary()), "sent": pa.array(sent, pa.binary())} | {c: pa.array(by_key[:, i] if not whole else [None] * len(n), pa.int64()) for i, c in enumerate(KEY_COLS)}
            )

    return docs.mapInArrow(sketched, "doc_id long, n long, sig binary, sent binary, " + ", ".join(f"{c} long" for c in KEY_COLS))


def blocks(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """node, block. Documents with pairs among each other come together: a label is the smallest document within two steps, and a label with more than UNIT shingles is split by hash. sizes: node, n."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("near"))
    dealt = lambda d, c: d.withColumn("h", F.xxhash64(c, F.lit(5)))
    far = dealt(both, "b").join(dealt(near.select(F.col("node").alias("b"), F.col("near").alias("of_b")), "b"), ["h", "b"]).groupBy(F.col("a").alias("node")).agg(F.min("of_b").alias("of_b"))
    labelled = near.join(far, "node").select("node", F.least("near", "of_b").alias("label")).join(sizes, "node")
    parts = labelled.groupBy("label").agg(F.ceil(F.sum("n") / UNIT).alias("parts"))
    return dealt(labelled, "label").join(dealt(parts, "label"), ["h", "label"]).select("node", F.xxhash64("label", F.pmod(F.xxhash64("node"), "parts")).alias("block"))


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of ids whose whole texts link; written. pairs: a table that was written."""
    import pyarrow as pa

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def gathered(batches):
        for batch in meeting.slices(batches):
            sets = list(shingle_sets(batch.column(1), width))
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "n": pa.array(list(map(len, sets)), pa.int64()), "shingles": pa.array([h.tobytes() for h in sets], pa.binary())})

    sets = written(meeting.sought(docs, ids, "doc_id").mapInArrow(gathered, "node long, n long, shingles binary"), "sets")
    placed = written(blocks(pairs, sets.groupBy("node").agg(F.sum("n").alias("n"))), "blocks")
    at = lambda d, x: d.join(placed.select(F.col("node").alias(x), F.col("block").alias(f"block_{x}")), x)
    asked = written(at(at(pairs.select("a", "b"), "a"), "b").select(F.xxhash64("block_a", "block_b").alias("unit"), "a", "b"), "units")
    members = asked.select("unit", F.col("a").alias("node")).unionByName(asked.select("unit", F.col("b").alias("node"))).distinct().join(sets, "node")
    rows = members.select("unit", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "shingles").unionByName(asked.select("unit", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("shingles")))

    def compared(batches):
        unit, known, places = None, {}, None
        for batch in batches:
            units, kind, a = (batch.column(i).to_numpy() for i in range(3))
            b, data, links = batch.column(3), batch.column(4), []
            cuts = meeting.starts_of(units)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if units[lo] != unit:  # a unit's sets come before its pairs
                    unit, known, places = units[lo], {}, None
                first = lo + int((kind[lo:hi] == 0).sum())
                for i in range(lo, first):
                    known.setdefault(int(a[i]), []).append(np.frombuffer(data[i].as_py(), "<u8"))
                if first == hi:
                    continue
                if places is None:
                    # shingles by number, so that one document's can be marked
                    every, numbers = np.unique(np.concatenate([h for sets_ in known.values() for h in sets_]), return_inverse=True)
                    places, begin = np.zeros(len(every), bool), 0
                    for node, sets_ in known.items():
                        ends = np.cumsum([len(h) for h in sets_]) + begin
                        known[node] = np.split(numbers[begin : ends[-1]], ends[:-1] - begin)
                        begin = int(ends[-1])
                xs, ys = a[first:hi], b.slice(first, hi - first).to_numpy(zero_copy_only=False)
                for x in np.unique(xs).tolist():
                    others = ys[xs == x].tolist()
                    of = np.array([y for y in others for _ in known[y]])
                    sets_ = [h for y in others for h in known[y]]
                    n, found = np.array([len(h) for h in sets_]), np.zeros(len(of), bool)
                    together = np.concatenate(sets_)
                    for h in known[x]:
                        places[h] = True
                        shared = np.add.reduceat(places[together], np.concatenate([[0], np.cumsum(n)[:-1]]))
                        places[h] = False
                        found |= 100 * shared >= percent * (n + len(h) - shared)
                    links += [(x, y) for y in np.unique(of[found]).tolist()]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})
        meeting.released()

    found = rows.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(compared, "a long, b long")
    found = written(found, "verified")
    dropped(sets, placed, asked)
    return found


def similar_size(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def stars(classes: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Each class with the smallest class of each of its keys, if they are in different components."""
    keyed = classes.select("node", "component", "n", F.posexplode(F.array(*keys)).alias("i", "key")).select("node", "component", "n", F.xxhash64("i", "key").alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("node", "component", "n")).alias("first"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key", "first")
    # joined on a hash of the key: both sides are dealt anew, so that adaptive execution can split a hot key
    dealt = lambda d: d.withColumn("h", F.xxhash64("key", F.lit(1)))
    return dealt(keyed).join(dealt(first), ["h", "key"]).where("component <> first.component").where(similar_size("n", "first.n", percent)).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, component, and more) with the components that links (a, b) between nodes join."""
    ends = groups.select("node", "component").distinct()
    at = lambda d, x: d.join(ends.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x)
    found = components(at(at(links, "a"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    named = found.select(F.col("node").alias("component"), F.col("component").alias("smallest"))
    dealt = lambda d: d.withColumn("h", F.xxhash64("component", F.lit(3)))
    kept = [c for c in groups.columns if c != "component"]
    return dealt(groups).join(dealt(named), ["h", "component"], "left").select(*kept, F.coalesce("smallest", "component").alias("component"))


def shared_shingles(sent: DataFrame, total: int, hot: int) -> DataFrame:
    """From (node, component, sent): hot = 0: (token, node, component) of the shingles that 2 to `hot` documents of two components or more share; hot > 0: how many more common ones node has sent."""
    import pyarrow as pa

    buckets = meeting.buckets_for(total)

    def common(tokens, node, component):
        """An order by token, component, node; in it: how many documents the token has, which of them this is, and which of its components, of how many."""
        order = np.lexsort((node, component, tokens))
        t, c = tokens[order], component[order]
        cuts = meeting.starts_of(t)
        docs = np.diff(cuts)
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])
        kinds = np.add.reduceat(new.astype(np.int64), cuts[:-1])
        nth_kind = np.cumsum(new) - np.repeat(np.cumsum(kinds) - kinds, docs)
        return order, np.repeat(docs, docs), np.arange(len(t)) - np.repeat(cuts[:-1], docs), new & (nth_kind == 2), np.repeat(kinds, docs)

    def counted(node):
        ids, k = np.unique(node, return_counts=True)
        return pa.RecordBatch.from_pydict({"hot": pa.array(k, pa.int64()), "token": pa.nulls(len(ids), pa.int64()), "node": pa.array(ids, pa.int64()), "component": pa.nulls(len(ids), pa.int64())})

    def sending(batches):
        for b in meeting.slices(batches, 500):
            parts = [_unpacked48(x) for x in b.column(2).to_pylist()]
            sizes = [len(p) for p in parts]
            if not sum(sizes):
                continue
            tokens = np.concatenate(parts)
            node = np.repeat(b.column(0).to_numpy(), sizes)
            component = np.repeat(b.column(1).to_numpy(), sizes)
            order, docs, nth, second, _ = common(tokens, node, component)
            # of a common shingle hot + 1 documents, and one of a second component, are enough to mark it; the rest is counted here
            rest = np.zeros(len(tokens), bool)
            rest[order] = (docs > hot) & (nth > hot) & ~second
            kept = ~rest
            out = meeting.packed(tokens[kept], {"node": node[kept].astype("<i8"), "ahead": (node - component)[kept].astype("<i8")}, buckets)
            if rest.any():
                ids, k = np.unique(node[rest], return_counts=True)
                # a row of counts: its bucket is below zero
                one = {"bucket": [-1 - int(ids[0]) % buckets], "lo": [b""], "hi": [b""], "node": [ids.astype("<i8").tobytes()], "ahead": [k.astype("<i8").tobytes()]}
                yield pa.RecordBatch.from_pydict(one, schema=out.schema)
            yield out

    def meeting_up(batches):
        rows = []
        for b in batches:
            beyond = b.column(0).to_numpy() < 0
            for i in np.flatnonzero(beyond):
                ids, k = np.frombuffer(b.column(3)[int(i)].as_py(), "<i8"), np.frombuffer(b.column(4)[int(i)].as_py(), "<i8")
                yield pa.RecordBatch.from_pydict({"hot": pa.array(k, pa.int64()), "token": pa.nulls(len(ids), pa.int64()), "node": pa.array(ids, pa.int64()), "component": pa.nulls(len(ids), pa.int64())})
            rows.append(b.filter(pa.array(~beyond)))
        if (all_ := meeting.met(rows, {"node": "<i8", "ahead": "<i8"})) is None:
            return
        tokens, more = all_
        # most shingles are in one document only: leave them before the full sort
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        twice = np.zeros(len(t), bool)
        twice[1:] = t[1:] == t[:-1]
        twice[:-1] |= twice[1:]
        some = order[twice]
        if not len(some):
            return
        tokens, node = tokens[some], more["node"][some]
        component = node - more["ahead"][some]
        order, docs, _, _, kinds = common(tokens, node, component)
        tokens, node, component = tokens[order], node[order], component[order]
        if (over := (docs > hot) & (kinds > 1)).any():
            yield counted(node[over])
        pick = (docs <= hot) & (kinds > 1)
        for lo in range(0, int(pick.sum()), 100_000):
            at = np.flatnonzero(pick)[lo : lo + 100_000]
            yield pa.RecordBatch.from_pydict({"hot": pa.array(np.zeros(len(at), np.int64)), "token": pa.array(tokens[at].astype(np.int64)), "node": pa.array(node[at], pa.int64()), "component": pa.array(component[at], pa.int64())})
        del rows, all_, more, tokens, node, component, order
        meeting.released()

    rows = meeting.dealt(sent.select("node", "component", "sent").mapInArrow(sending, meeting.schema(["node", "ahead"])), buckets)
    return rows.mapInArrow(meeting_up, "hot long, token long, node long, component long")


def candidates(postings: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b, shared: pairs of different components that share as many prefix shingles as either requires. nodes: node, n, l."""
    p = postings.join(nodes.select("node", "n", "l"), "node").select("token", "node", "component", "n", "l")
    a, b = (p.select("token", *[F.col(c).alias(c + x) for c in ("node", "component", "n", "l")]) for x in "ab")
    pairs = a.join(b, "token").where("nodea < nodeb and componenta <> componentb").where(similar_size("na", "nb", percent))
    return pairs.groupBy(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("la", "lb")).alias("need")).where("shared >= need").select("a", "b", "shared")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, hot: int = HOT, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = written(sketch(docs, width, percent), "sketch")
    groups = base.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in KEY_COLS]).withColumn("component", F.col("node"))
    groups = written(groups, "classes")
    for i in range(rounds):
        pairs = written(stars(groups, KEY_COLS[i * KEYS : (i + 1) * KEYS], percent), "stars")
        if not pairs.isEmpty():
            groups = joined(groups, pairs, docs, width, percent)
        dropped(pairs)
    nodes = groups.select("sig", "node", "n", "component")

    pairs = apart(base, docs, nodes, width, percent, hot)
    last = groups if pairs.isEmpty() else joined(groups.select("sig", "node", "n", "component"), pairs, docs, width, percent, groups)
    dropped(pairs)
    dealt = lambda d: d.withColumn("h", F.xxhash64("sig", F.lit(2)))
    named = last.select("sig", F.col("component").alias("component_id"))
    return dealt(base.select("doc_id", "n", "sig")).join(dealt(named), ["h", "sig"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def joined(groups: DataFrame, pairs: DataFrame, docs: DataFrame, width: int, percent: int, old: DataFrame | None = None) -> DataFrame:
    """groups with the components that the pairs' links join, written; the table that groups was (or `old`) is deleted."""
    links = verified(pairs, docs, width, percent)
    out = written(merged(groups, links), "classes")
    dropped(links, groups if old is None else old)
    return out


def apart(base: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int, hot: int) -> DataFrame:
    """a, b: the pairs of different components that may link; written."""
    whole_class = nodes.withColumnRenamed("sig", "of_sig")
    of_class = base.select("sig", "doc_id", "sent").join(whole_class, (F.col("sig") == F.col("of_sig")) & (F.col("doc_id") == F.col("node"))).select("node", "component", "n", "sent")
    total = int(nodes.selectExpr(f"sum(n) * {100 - percent} div 100 * 6 div 5 as t").first().t or 0)
    needed = f"(n - ({percent} * n + 99) div 100 + 1)"
    longer, tables = None, []
    while True:
        sent, length = of_class, nodes.select("node", "n", "component").withColumn("whole", F.lit(False))
        if longer is not None:
            ids = longer.select(F.col("node").alias("doc_id")).distinct()
            all_of = written(sketch(meeting.sought(docs, ids, "doc_id"), width, percent, whole=True).select(F.col("doc_id").alias("node"), "sent", F.col("n").alias("n_")), "whole")
            tables.append(all_of)
            sent = of_class.join(longer.select("node"), "node", "left_anti").unionByName(longer.join(all_of, "node").where("n = n_").select("node", "component", "n", "sent"))
            length = length.drop("whole").join(longer.select("node", F.lit(True).alias("whole")).distinct(), "node", "left")
        found = written(shared_shingles(sent, total, hot), "shared")
        cost = found.where("hot > 0").groupBy("node").agg(F.sum("hot").alias("hot"))
        length = length.join(cost, "node", "left").withColumn("sent_n", F.when(F.coalesce("whole", F.lit(False)), F.col("n")).otherwise(F.expr(f"least(n, {needed} * 6 div 5 + 6)")))
        length = written(length.select("node", "n", "component", "sent_n", F.expr(f"sent_n - coalesce(hot, 0) - {needed} + 1").alias("l")), "prefixes")
        tables += [found, length]
        if length.where("l < 1 and sent_n < n").isEmpty():
            break
        close = length.where(f"l < 3 + {needed} div 10 and sent_n < n").select("node", "component", "n")
        longer = written(close if longer is None else close.unionByName(longer).distinct(), "longer")
        tables.append(longer)

    pairs = candidates(found.where("hot = 0"), length.withColumn("l", F.greatest("l", F.lit(1))), percent).select("a", "b")
    common = length.where("l < 1").select("node", "component", "n")
    if not common.isEmpty():
        ids = common.select(F.col("node").alias("doc_id")).distinct()
        tokens = written(tokens_of(meeting.sought(docs, ids, "doc_id"), width), "tokens")
        tables.append(tokens)
        pairs = pairs.unionByName(among(tokens, common, percent)).distinct()
    pairs = written(pairs, "pairs")
    dropped(*tables)
    return pairs


def tokens_of(texts: DataFrame, width: int) -> DataFrame:
    """node, size (of the set, to tell texts that share an id) and token, a row a shingle."""
    import pyarrow as pa

    def exploded(batches):
        for batch in meeting.slices(batches, 50):
            sets = list(shingle_sets(batch.column(1), width))
            n = np.array([len(h) for h in sets])
            yield pa.RecordBatch.from_pydict({"node": pa.array(np.repeat(batch.column(0).to_numpy(), n), pa.int64()), "size": pa.array(np.repeat(n, n), pa.int64()), "token": pa.array(np.concatenate(sets).view(np.int64), pa.int64())})

    return texts.mapInArrow(exploded, "node long, size long, token long").distinct()


def among(tokens: DataFrame, common: DataFrame, percent: int, listed: int = 64) -> DataFrame:
    """Pairs of the common documents that may link: the way for documents made of common shingles alone.

    Their order of shingles: those of one component first, which no pair shares, then the others, the rarest first. At the first shingle
    that a pair shares, its places i and j (from 1) in both orders leave at most 1 + min(n - i, n' - j) to share, which must reach the
    overlap that 0.75 needs; places beyond that are dropped. A pair is made at its first shared shingle only, as far as the shingles before
    it are listed with each (at most `listed`); with longer lists it may come several times, and is made distinct."""
    dealt = lambda d, i: d.withColumn("h", F.xxhash64("token", F.lit(i)))
    mine = tokens.join(common.select("node", "component", F.col("n").alias("size")).distinct(), ["node", "size"])
    spread = mine.groupBy("token").agg(F.count("*").alias("df"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("token", "df")
    shared = dealt(mine, 6).join(dealt(spread, 6), ["h", "token"]).select("node", "component", F.col("size").alias("n"), "token", "df")
    ordered = shared.groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    # no place beyond is early enough, even for the smallest document that may link
    early = ordered.withColumn("own", F.col("n") - F.size("t")).withColumn("t", F.slice("t", F.lit(1), F.greatest(F.lit(0), F.expr(f"cast(n - ({percent} * n + 99) div 100 + 1 - own as int)"))))
    before = lambda i: F.when(F.size("t") <= listed, F.transform(F.slice("t", F.lit(1), i), lambda x: x["token"])).otherwise(F.array().cast("array<long>"))
    p = early.select("node", "component", "n", "own", "t", F.posexplode(F.transform("t", lambda x: x["token"])).alias("i", "token")).select("token", "node", "component", "n", (F.col("own") + F.col("i") + 1).alias("place"), before(F.col("i")).alias("before"))
    a, b = (dealt(p.select("token", *[F.col(c).alias(c + x) for c in ("node", "component", "n", "place", "before")]), 7) for x in "ab")
    enough = F.expr(f"(100 + {percent}) * (1 + least(na - placea, nb - placeb)) >= {percent} * (na + nb)")
    return a.join(b, ["h", "token"]).where("nodea < nodeb and componenta <> componentb").where(similar_size("na", "nb", percent)).where(enough).where(~F.arrays_overlap("beforea", "beforeb")).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest id; and those without an id. With the columns of docs."""
    stay = join(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.other) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
