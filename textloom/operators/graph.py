"""The language graph as tables: counts, adjacent pairs, windows, skip-grams, decay, compaction, resonance, expectation.

Tokens are a row each (doc_id, sid, pos, w); sentences an array (doc_id, sid, ws). Counts are sums with map-side partial aggregation,
so hot words cost a row a task. Pairs are exploded from the sentence's own array: no join, no shuffle before the count. Every top-k has
a total order (weight descending, word ascending).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.sources.storage import stored

#: Fixed values.
WINDOW, SKIP_FROM, SKIP_TO, LAST = 3, 2, 7, 50
DECAY, DECAY_EVERY, DROP_BELOW = 0.97, 100, 0.01
KEEP = {"next": 50, "near": 100, "skip": 50, "resonance": 30}
RESONANCE_TOP, RESONANCE_STEP, DISCOUNT, DISCOUNT_STEP, DISCOUNT_MOST = 5, 0.1, 0.6, 0.08, 0.95
EXPECT_P, EXPECT_RANK = 0.4, 0.6


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sid, ws: the sentences with two tokens or more. sid counts all pieces of the text, kept or not."""
    # made inside the array, before it is exploded: a filter on a column of rows would have the tokens made twice
    piece = lambda s: F.when(F.length(tx.trim_all(s)) > tx.MIN_SENTENCE, tx.model_tokens(s))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.transform(F.split(text_col, tx.SENTENCE_END), piece)).alias("sid", "ws")).where(F.size("ws") >= 2)


def tokens(sents: DataFrame) -> DataFrame:
    return sents.select("doc_id", "sid", F.size("ws").alias("len"), F.posexplode("ws").alias("pos", "w"))


def numbered(sents: DataFrame, block: int = 1024) -> DataFrame:
    """sents with ns, the sentence's number from 1 in the order of (doc_id, sid): offsets by block of ids, then by document, so no window holds the corpus."""
    per_doc = sents.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("doc_id") / block))
    blocks = per_doc.groupBy("block").agg(F.sum("n").alias("n"))
    before_block = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("b0"))
    before_doc = per_doc.withColumn("d0", F.sum("n").over(Window.partitionBy("block").orderBy("doc_id")) - F.col("n")).join(before_block, "block").select("doc_id", (F.col("b0") + F.col("d0")).alias("before"))
    in_doc = sents.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("sid")))
    return in_doc.join(before_doc, "doc_id").select("doc_id", "sid", "ws", (F.col("before") + F.col("k")).alias("ns"))


def _pairs(ws: Column, distance: int) -> Column:
    """Structs (a, b) of the words that stand `distance` apart."""
    return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - distance, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.get(ws, i + distance).alias("b")))


def next_words(sents: DataFrame) -> DataFrame:
    return sents.select(F.explode(_pairs(F.col("ws"), 1)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def trigrams(sents: DataFrame) -> DataFrame:
    three = F.transform(F.slice("ws", 1, F.greatest(F.size("ws") - 2, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.get("ws", i + 1).alias("b"), F.get("ws", i + 2).alias("c")))
    return sents.select(F.explode(three).alias("p")).groupBy("p.a", "p.b", "p.c").agg(F.count("*").alias("n"))


def near_words(sents: DataFrame, reach: int = WINDOW) -> DataFrame:
    """a, b, n: how often b stands within `reach` words of a."""
    pairs = F.flatten(F.array(*[_pairs(F.col("ws"), d) for d in range(1, reach + 1)]))
    # being near is mutual: each pair of places is counted once, whatever its order, and its sum stands both ways
    counts = sents.select(F.explode(pairs).alias("p")).groupBy(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).agg(F.count("*").alias("n"))
    way = lambda x, y, n: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), n.alias("n"))
    ways = F.when(F.col("a") == F.col("b"), F.array(way("a", "b", F.col("n") * 2))).otherwise(F.array(way("a", "b", F.col("n")), way("b", "a", F.col("n"))))
    return counts.select(F.explode(ways).alias("p")).select("p.a", "p.b", "p.n")


def skip_words(sents: DataFrame, first: int = SKIP_FROM, last: int = SKIP_TO, words: DataFrame | None = None) -> DataFrame:
    """a, b, weight = sum of 1 / distance, close: once at least with a place that is within WINDOW of both. Counted by distance first, in whole numbers, so that any order of the sum gives the same. words: only of these a (w); they are sent to every task, so that the corpus' places stay where they are."""
    ahead = F.transform("ws", lambda x, i: F.struct(x.alias("a"), F.slice("ws", i + first + 1, F.lit(last - first + 1)).alias("bs")))
    places = sents.select(F.explode(ahead).alias("p")).select("p.a", "p.bs")
    if words is not None:
        places = places.join(F.broadcast(words.select(F.col("w").alias("a"))), "a", "left_semi")
    exploded = places.select("a", F.posexplode("bs").alias("p", "b")).select("a", "b", (F.col("p") + first).alias("d"))
    counts = exploded.groupBy("a", "b").agg(*[F.count(F.when(F.col("d") == d, 1)).alias(f"n{d}") for d in range(first, last + 1)])
    weight = sum((F.col(f"n{d}") / d for d in range(first + 1, last + 1)), F.col(f"n{first}") / first)
    close = sum((F.col(f"n{d}") for d in range(first + 1, min(last, 2 * WINDOW) + 1)), F.col(f"n{first}")) > 0
    return counts.select("a", "b", weight.alias("weight"), close.alias("close"))


def pair_counts(sents: DataFrame, reach: int = WINDOW, first: int = SKIP_FROM, last: int = SKIP_TO) -> DataFrame:
    """x, y (x <= y); n, m: how often y follows x, and x follows y; near, skip, back: whether they stand within `reach` words, y stands `first` to `last` words behind x, and x behind y. All
    pairs of places up to `last` words apart are summed once, in place of once for each table, where it only matters which pairs there are."""
    ahead = F.transform("ws", lambda a, i: F.struct(a.alias("a"), F.slice("ws", i + 2, F.lit(max(reach, last))).alias("bs")))
    places = sents.select(F.explode(ahead).alias("p")).select("p.a", F.posexplode("p.bs").alias("p", "b"))
    d, there = F.col("p") + 1, F.col("a") <= F.col("b")
    skip = d.between(first, last)
    seen = places.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), ((d == 1) & there).cast("int").alias("n"), ((d == 1) & ~there).cast("int").alias("m"), (d <= reach).alias("near"), (skip & there).alias("skip"), (skip & ~there).alias("back"))
    return seen.groupBy("x", "y").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), *[F.bool_or(c).alias(c) for c in ("near", "skip", "back")])


def directed(pairs: DataFrame) -> DataFrame:
    """a, b, n: of `pair_counts` the adjacent ones, as `next_words` gives them."""
    way = lambda a, b, n: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(n).alias("n"))
    return pairs.select(F.explode(F.filter(F.array(way("x", "y", "n"), way("y", "x", "m")), lambda p: p["n"] > 0)).alias("p")).select("p.a", "p.b", "p.n")


def top(edges: DataFrame, k: int, src: str = "a", dst: str = "b", weight: str = "n") -> DataFrame:
    """The k heaviest edges of each source, with their rank from 1; the rank's limit is applied before the shuffle, too."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(src).orderBy(F.desc(weight), dst))).where(F.col("rank") <= k)


def decayed(sents: DataFrame, every: int = DECAY_EVERY, factor: float = DECAY, least: float = DROP_BELOW) -> DataFrame:
    """Adjacent pairs, an occurrence in sentence k weighted factor^(floor(N / every) - floor((k - 1) / every)); light ones dropped."""
    n = numbered(sents)
    events = n.select(F.floor((F.col("ns") - 1) / every).alias("epoch"), F.explode(_pairs(F.col("ws"), 1)).alias("p"))
    counts = events.groupBy("p.a", "p.b", "epoch").agg(F.count("*").alias("k"))
    last = n.agg(F.floor(F.max("ns") / every).alias("last"))
    weighed = counts.crossJoin(F.broadcast(last)).groupBy("a", "b").agg(F.sum(F.col("k") * F.pow(F.lit(factor), F.col("last") - F.col("epoch"))).alias("weight"))
    return weighed.where(F.col("weight") >= least)


def upper_median(df: DataFrame, col: str) -> DataFrame:
    """sorted[floor(n / 2)], from a histogram: its size is that of the distinct values."""
    hist = df.groupBy(col).agg(F.count("*").alias("k"))
    upto = hist.select(col, F.sum("k").over(Window.orderBy(col)).alias("upto"), F.sum("k").over(Window.partitionBy()).alias("all"))
    return upto.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min(col).alias(col))


def inhibition(freq: DataFrame, degree: DataFrame) -> DataFrame:
    """w, weight: common and well connected words are damped. freq: w, n; degree: w, degree. Written once, as the medians and the weights read it."""
    both = stored(freq.join(degree, "w", "left").select("w", "n", F.coalesce("degree", F.lit(0)).alias("degree")), "degrees")
    medians = upper_median(both, "n").withColumnRenamed("n", "mn").crossJoin(upper_median(both, "degree").withColumnRenamed("degree", "md"))
    raw = 0.5 / F.log2(F.col("n") / F.greatest("mn", F.lit(1)) + 2) + 0.5 / F.log2(F.col("degree") / F.greatest("md", F.lit(1)) + 2)
    return both.crossJoin(F.broadcast(medians)).select("w", "n", "degree", F.least(F.greatest(raw, F.lit(0.1)), F.lit(1.0)).alias("weight"))


def batch_resonance(nx: DataFrame, k: int = RESONANCE_TOP) -> DataFrame:
    """a, b, resonance (both directions): words that fill the same slot. After p, each occurrence of w resonates with the k commonest
    successors of p; before s likewise. This is the set-based form; the order-dependent one is `resonance_exact`."""
    # a word's few commonest are one row, so that a join gives a row a pair
    few = lambda src, dst: top(nx, k, src, dst).groupBy(src).agg(F.collect_list(dst).alias("ts"))
    after = nx.join(few("a", "b"), "a").select(F.col("b").alias("w"), "n", F.explode("ts").alias("t"))
    before = nx.join(few("b", "a"), "b").select(F.col("a").alias("w"), "n", F.explode("ts").alias("t"))
    # resonance is mutual: each pair is summed once, whatever its order, and stands both ways
    one = after.unionByName(before).where("w <> t").groupBy(F.least("w", "t").alias("a"), F.greatest("w", "t").alias("b")).agg(F.sum("n").alias("n"))
    way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col("n").alias("n"))
    both = one.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).select("p.a", "p.b", "p.n")
    return both.select("a", "b", (F.col("n") * RESONANCE_STEP).alias("resonance"))


def discount(resonance: Column) -> Column:
    return F.least(DISCOUNT + DISCOUNT_STEP * resonance, F.lit(DISCOUNT_MOST))


def soft_next(nx: DataFrame, res: DataFrame, k: int = RESONANCE_TOP, words: DataFrame | None = None) -> DataFrame:
    """a, b, weight, soft: the successors of a, and those of its k strongest partners that a hasn't itself (the strongest partner's count, discounted). words: only of these a (w)."""
    every = nx
    if words is not None:
        of = words.select(F.col("w").alias("a"))
        nx, res = nx.join(of, "a", "left_semi"), res.join(of, "a", "left_semi")
    partners = top(res.join(every.select(F.col("a").alias("b")).distinct(), "b"), k, "a", "b", "resonance").select("a", F.col("b").alias("partner"), F.col("rank"), discount(F.col("resonance")).alias("d"))
    lent = partners.join(every.select(F.col("a").alias("partner"), "b", "n"), "partner").select("a", "b", F.col("n") * F.col("d"), "rank").toDF("a", "b", "weight", "rank")
    new = lent.join(nx.select("a", "b"), ["a", "b"], "left_anti")
    first = new.groupBy("a", "b").agg(F.min_by("weight", "rank").alias("weight"))
    return nx.select("a", "b", F.col("n").cast("double").alias("weight"), F.lit(False).alias("soft")).unionByName(first.withColumn("soft", F.lit(True)))


def ranked_next(nx: DataFrame) -> DataFrame:
    """a, b, expected = 0.4 P(b | a) + 0.6 (1 - rank / successors)."""
    w = Window.partitionBy("a")
    p = F.col("n") / F.sum("n").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("n"), "b")) - 1
    return nx.select("a", "b", (EXPECT_P * p + EXPECT_RANK * (1 - rank / F.count("*").over(w))).alias("expected"))


def follow_sums(sents: DataFrame, best: int = 3) -> DataFrame:
    """w; ftot, fn, ftop, ftop3: how often a word is followed, by how many words, by the commonest and by the `best` commonest ones; ptot,
    pn, ptop likewise of what it follows; inter: the words on both sides of it. A pair is counted once for both ways; of a word's
    followers only the counts matter, so it has a row a distinct count, summed before the shuffle."""
    a, b = F.col("p.a"), F.col("p.b")
    way = lambda where: F.sum(F.when(where, 1).otherwise(0))
    both = sents.select(F.explode(_pairs(F.col("ws"), 1)).alias("p")).groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(way(a <= b).alias("there"), way(a > b).alias("back"))
    mutual = ((F.col("there") > 0) & (F.col("back") > 0)) | (F.col("x") == F.col("y"))
    row = lambda w, ahead, n: F.struct(F.col(w).alias("w"), F.lit(ahead).alias("ahead"), F.col(n).alias("n"), (mutual if ahead else F.lit(False)).cast("int").alias("mutual"))
    rows = F.filter(F.array(row("x", True, "there"), row("y", False, "there"), row("y", True, "back"), row("x", False, "back")), lambda r: r["n"] > 0)
    hist = both.select(F.explode(rows).alias("r")).groupBy("r.w", "r.ahead", "r.n").agg(F.count("*").alias("k"), F.sum("r.mutual").alias("mutual"))
    before = F.sum("k").over(Window.partitionBy("w").orderBy(F.desc("ahead"), F.desc("n"))) - F.col("k")
    top = F.when(F.col("ahead"), F.col("n") * F.least("k", F.greatest(best - F.col("before"), F.lit(0))))
    side = lambda x, of: [F.sum(F.when(of, F.col("n") * F.col("k"))).alias(f"{x}tot"), F.sum(F.when(of, F.col("k"))).alias(f"{x}n"), F.max(F.when(of, F.col("n"))).alias(f"{x}top")]
    return hist.withColumn("before", before).groupBy("w").agg(*side("f", F.col("ahead")), F.sum(top).alias("ftop3"), *side("p", ~F.col("ahead")), F.sum("mutual").alias("inter")).na.fill(0)


def coherence(sents: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, steps, coherence: how expected each word is after the one before it, on average."""
    pairs = sents.select(*keys, F.explode(_pairs(F.col("ws"), 1)).alias("p")).select(*keys, "p.a", "p.b")
    scored = pairs.join(expected, ["a", "b"], "left")
    return scored.groupBy(*keys).agg(F.count("*").alias("steps"), F.avg(F.coalesce("expected", F.lit(0.0))).alias("coherence"))


def richness(pairs: DataFrame, res: DataFrame) -> DataFrame:
    """w, richness: in- and out-degrees, weighted. pairs: of `pair_counts`."""
    one = lambda c: c.cast("int")
    next_ = one(F.col("n") > 0) + one(F.col("m") > 0)
    side = lambda w, n, skip: F.struct(F.col(w).alias("w"), n.alias("next"), one(F.col(skip)).alias("skip"), one(F.col("near")).alias("near"), F.lit(0).alias("res"))
    # a word beside itself is followed by and follows itself
    rows = F.when(F.col("x") == F.col("y"), F.array(side("x", 2 * next_, "skip"))).otherwise(F.array(side("x", next_, "back"), side("y", next_, "skip")))
    kinds = ("next", "skip", "near", "res")
    partners = res.groupBy(F.col("a").alias("w")).agg(F.count("*").alias("res")).select("w", *[F.lit(0).alias(c) for c in kinds[:3]], "res")
    whole = pairs.select(F.explode(rows).alias("r")).select("r.*").unionByName(partners).groupBy("w").agg(*[F.sum(c).alias(c) for c in kinds])
    return whole.select("w", (F.col("next") * 1.0 + F.col("skip") * 0.5 + F.col("near") * 0.3 + F.col("res") * 0.5).alias("richness"))


def stats(freq: DataFrame, bigrams: DataFrame, pairs: DataFrame, tri: DataFrame, res: DataFrame, mature: int = 10) -> DataFrame:
    """name, value: the sizes of the graph's tables. pairs: of `pair_counts`."""
    n = lambda where: F.count(F.when(where, 1))
    row = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    both = F.when(F.col("x") == F.col("y"), 1).otherwise(2)
    rows = [freq.agg(F.array(row("vocabulary", F.count("*")), row("mature", n(F.col("n") >= mature))).alias("r"))]
    rows.append(pairs.agg(F.array(row("transitions", n(F.col("n") > 0) + n(F.col("m") > 0)), row("cooccurrences", F.coalesce(F.sum(F.when(F.col("near"), both)), F.lit(0))), row("skip_grams", n(F.col("skip")) + n(F.col("back")))).alias("r")))
    rows += [d.agg(F.array(row(name, F.count("*"))).alias("r")) for name, d in (("bigrams", bigrams), ("trajectories", tri))]
    rows.append(res.agg(F.array(row("resonance_pairs", F.floor(F.count("*") / 2))).alias("r")))
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return whole.select(F.explode("r").alias("r")).select("r.*")


#: The first step of a wave.
WAVE_ENERGY, WAVE_TOP = 0.3, 15
WAVE_SHARE = {"near": 0.30, "next": 0.25, "resonance": 0.25, "skip": 0.20}


def activated(near: DataFrame, nx: DataFrame, res: DataFrame, skip: DataFrame, damping: DataFrame, k: int = WAVE_TOP) -> DataFrame:
    """w, node, energy: what a word excites in one step. Of each kind of edge the k heaviest share their part of the energy, resonant
    partners have their discount of it, and every node is damped by its own weight."""

    def share(edges: DataFrame, weight: str, part: float) -> DataFrame:
        t = top(edges, k, weight=weight).withColumn("all", F.sum(weight).over(Window.partitionBy("a")))
        return t.select("a", "b", (F.lit(WAVE_ENERGY * part) * F.col(weight) / F.col("all")).alias("e"))

    partners = top(res, k, weight="resonance").select("a", "b", (F.lit(WAVE_ENERGY * WAVE_SHARE["resonance"]) * discount(F.col("resonance"))).alias("e"))
    edges = share(near, "n", WAVE_SHARE["near"]).unionByName(share(nx, "n", WAVE_SHARE["next"])).unionByName(partners).unionByName(share(skip, "weight", WAVE_SHARE["skip"]))
    damped = edges.join(damping.select(F.col("w").alias("b"), "weight"), "b")
    return damped.groupBy(F.col("a").alias("w"), F.col("b").alias("node")).agg(F.sum(F.col("e") * F.col("weight")).alias("energy"))


def resonance_exact(sentences: list[list[str]], k: int = RESONANCE_TOP, step: float = RESONANCE_STEP) -> dict[tuple[str, str], float]:
    """The order-dependent resonance of a small corpus, sentence by sentence on the driver: each word meets the k commonest successors
    that its predecessor has had so far, and the k commonest predecessors of its successor."""
    after: dict[str, dict[str, int]] = {}
    before: dict[str, dict[str, int]] = {}
    found: dict[tuple[str, str], float] = {}

    def meet(w: str, seen: dict[str, int]) -> None:
        for t in sorted(seen, key=lambda x: (-seen[x], x))[:k]:
            if t != w:
                for pair in ((w, t), (t, w)):
                    found[pair] = found.get(pair, 0.0) + step

    for ws in sentences:
        for i, w in enumerate(ws):
            if i:
                meet(w, after.get(ws[i - 1], {}))
            if i + 1 < len(ws):
                meet(w, before.get(ws[i + 1], {}))
        for a, b in zip(ws, ws[1:], strict=False):
            after.setdefault(a, {})[b] = after.setdefault(a, {}).get(b, 0) + 1
            before.setdefault(b, {})[a] = before.setdefault(b, {}).get(a, 0) + 1
    return found


VOWELS = ("a", "e", "i", "o", "u")


def form_vector(w: Column) -> Column:
    """Sixteen numbers of a word's shape: its pattern of vowels and consonants. The pattern is made once, a text of 1 (vowel) and 0, and counted in."""
    letters = F.regexp_replace(F.regexp_replace(w, f"[^{''.join(VOWELS)}]", "0"), f"[{''.join(VOWELS)}]", "1")
    # bound once: named again, it would be made again
    return F.get(F.transform(F.array(F.struct(w.alias("w"), letters.alias("v"))), lambda x: _form_numbers(x["w"], x["v"])), F.lit(0))


def _form_numbers(w: Column, v: Column) -> Column:
    n = F.length(v)
    size = n.cast("double")
    times = lambda text, part: (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)
    ones, up, down = times(v, "1"), times(v, "01"), times(v, "10")
    sign = lambda c: F.when(c == "1", 1.0).when(c == "0", -1.0)
    mean = lambda text: (2 * times(text, "1") - F.length(text)) / F.length(text)
    # runs of like letters end where the other kind begins, or at the word's end
    alike = lambda count, ends, last: count - ends - (F.right(v, F.lit(1)) == last).cast("int")
    longest = lambda other: F.array_max(F.transform(F.split(v, other), F.length)) / size
    third = F.floor(n / 3).cast("int")
    two, many = n >= 2, n >= 3
    zero = F.lit(0.0)
    pair = lambda count: F.when(two, count / (size - 1)).otherwise(zero)
    three = lambda pattern: F.when(many, F.regexp_count(v, F.lit(pattern)) / (size - 2)).otherwise(zero)
    numbers = [
        pair(up + down), longest("1"), longest("0"), sign(F.substring(v, 1, 1)), sign(F.right(v, F.lit(1))),
        F.when(many, mean(F.substring(v, 2 * third + 1, n)) - mean(F.substring(v, F.lit(1), third))).otherwise(zero), ones / size,
        F.when(two, 2 * F.sqrt(ones * (size - ones)) / size).otherwise(zero),
        pair(up), pair(down), pair(alike(size - ones, up, "0")), pair(alike(ones, down, "1")),
        three("0(?=10)"), three("1(?=01)"), F.size(F.array_distinct(F.split(w, ""))) / size, F.least(size / 15, F.lit(1.0)),
    ]
    return F.array(*numbers)
