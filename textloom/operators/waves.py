"""Waves over the language graph: spreading activation over two hops, in context or without, settling, and sentences scored by them.

A field is a table of rows (key, node, energy). Everything that a wave needs of the graph is cut to a bounded number of edges a word:
15 of each kind at the first hop, 8 of each kind at the second, which starts from 5 nodes at most. So a wave has at most 180 nodes, and
a step of activation is two joins on words and one sum by (key, node), partially summed before the shuffle; a common word's edges are cut
by a ranked window, which Spark limits before it shuffles. Only the words that are asked for are followed.

Settling is a step of such sums repeated at most three times, over the keys that haven't converged; convergence is a cosine in the data.

Scoring a sentence folds its words from left to right, each gated by the field so far, so it is sequential within a sentence. Sentences
are dealt into buckets; a bucket gets the edges of the words and nodes that occur in its sentences, once each, and folds its sentences
one after the other. What a task holds grows with the bucket, not with the vocabulary.

Energies are ranked as rounded to 12 places, equal ones by node, so any order of sums gives the same choice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import graph as g
from textloom.sources.storage import stored

#: Fixed values.
DECAY, FIRST_EDGES, SECOND_NODES, SECOND_EDGES = 0.3, 15, 5, 8
SHARE = {"near": 0.30, "next": 0.25, "resonance": 0.25, "skip": 0.20}
GATE_LOW, GATE_HIGH = 0.4, 1.5
SETTLE_ROUNDS, SETTLE_EPSILON, SETTLE_TOP, SETTLE_DECAY = 3, 0.01, 8, 0.5
SURPRISE = {"wave": 0.30, "sequence": 0.40, "synchrony": 0.30}
STRENGTH, COHERENT_BELOW, LEAST_GATE, TOP_SHARE, SETTLED_SHARE = 0.6, 0.7, 0.05, 0.2, 0.2
ACCEPT_DELTA = 0.001
NOISE, KNOWN_BONUS, OVERRULE = 0.001, 0.01, 0.05
PLACES = 12
#: Sentences of a bucket, which one task folds, pairs of words of one, and parts of a cogroup at most.
PER_BUCKET, PAIRS_PER_BUCKET, MOST_PARTS = 64, 4096, 10_000


@dataclass(frozen=True)
class Graph:
    """near, next (a, b, n), res (a, b, resonance), damping (w, n, degree, weight); alone (a, b), the pairs that stand in sentences of two words; and the sentences (ws), of which skip-grams are counted for the words that are asked for only."""

    near: DataFrame
    next: DataFrame
    res: DataFrame
    damping: DataFrame
    alone: DataFrame
    sents: DataFrame

    def skip(self, words: DataFrame | None = None) -> DataFrame:
        """a, b, weight, close: of the words (w), or of all."""
        return g.skip_words(self.sents, words=words)


def build(sents: DataFrame) -> Graph:
    """The tables of a corpus' sentences, each written once, the sentences too."""
    sents = stored(sents, "sentences")
    near, nx = stored(g.near_words(sents), "near"), stored(g.next_words(sents), "next")
    freq, degree = g.tokens(sents).groupBy("w").agg(F.count("*").alias("n")), near.groupBy(F.col("a").alias("w")).agg(F.count("*").alias("degree"))
    damping = stored(g.inhibition(stored(freq, "freq"), degree), "damping")
    two = sents.where(F.size("ws") == 2).select(F.explode(F.array("ws", F.reverse("ws"))).alias("p")).select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"))
    return Graph(near, nx, stored(g.batch_resonance(nx), "resonance"), damping, stored(two.distinct(), "alone"), sents)


def _of(edges: DataFrame, words: DataFrame | None) -> DataFrame:
    """The edges that leave `words` (w)."""
    return edges if words is None else edges.join(words.select(F.col("w").alias("a")), "a", "left_semi")


def _shares(edges: DataFrame, weight: str, k: int, part: float, close: Column) -> DataFrame:
    """Each word's k heaviest edges share a part of its energy. close: whether both stand within reach of a third place, if their sentence has one."""
    return g.top(edges, k, weight=weight).select("a", "b", (F.lit(part) * F.col(weight) / F.sum(weight).over(Window.partitionBy("a"))).alias("e"), close.alias("close"), F.lit(False).alias("resonant"))


def _partners(res: DataFrame, k: int, part: float) -> DataFrame:
    return g.top(res, k, weight="resonance").select("a", "b", (F.lit(part) * g.discount(F.col("resonance"))).alias("e"), F.lit(False).alias("close"), F.lit(True).alias("resonant"))


def _summed(graph: Graph, parts: list[DataFrame], key: str, node: str) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    damped = whole.join(graph.damping.select(F.col("w").alias("b"), "weight"), "b")
    return damped.groupBy(F.col("a").alias(key), F.col("b").alias(node)).agg(F.sum(F.col("e") * F.col("weight")).alias("e"), F.bool_or("close").alias("close"), F.bool_or("resonant").alias("resonant"))


def first_hop(graph: Graph, words: DataFrame | None = None) -> DataFrame:
    """w, node, e, sure: at most 60 nodes a word. sure: the two are linked, see `linked`, as they resonate or stand close in a sentence of
    three words or more: within reach of each other, or of a place between them; what stands at that third place is near to both."""
    d, k, yes = DECAY, FIRST_EDGES, F.lit(True)
    parts = [_shares(_of(graph.near, words), "n", k, d * SHARE["near"], yes), _shares(_of(graph.next, words), "n", k, d * SHARE["next"], yes), _partners(_of(graph.res, words), k, d * SHARE["resonance"])]
    hop = _summed(graph, [*parts, _shares(graph.skip(words), "weight", k, d * SHARE["skip"], F.col("close"))], "w", "node")
    alone = graph.alone.select(F.col("a").alias("w"), F.col("b").alias("node"), F.lit(True).alias("alone"))
    # a pair that stands alone somewhere may have company elsewhere: it isn't sure
    return hop.join(alone, ["w", "node"], "left").select("w", "node", "e", (F.col("resonant") | (F.col("close") & F.col("alone").isNull())).alias("sure"))


def second_hop(graph: Graph, nodes: DataFrame | None = None) -> DataFrame:
    """w, target, e: what a node (w) passes on, at most 24 targets."""
    d, k, no = DECAY * DECAY, SECOND_EDGES, F.lit(False)
    parts = [_shares(_of(graph.near, nodes), "n", k, d * SHARE["near"], no), _shares(_of(graph.next, nodes), "n", k, d * SHARE["next"], no), _partners(_of(graph.res, nodes), k, d * SHARE["resonance"])]
    return _summed(graph, parts, "w", "target").select("w", "target", "e")


def linked(graph: Graph, pairs: DataFrame) -> DataFrame:
    """The pairs (w, node) that share a neighbour or resonate: through these a wave goes on. Neighbours are looked up from the side that has fewer, so a common word's are never listed for each of its pairs."""
    degree = graph.damping.select("w", "degree")
    sized = pairs.join(degree.withColumnRenamed("degree", "dw"), "w").join(degree.select(F.col("w").alias("node"), F.col("degree").alias("dn")), "node")
    fewer = F.col("dw") <= F.col("dn")
    sides = sized.select("w", "node", F.when(fewer, F.col("w")).otherwise(F.col("node")).alias("a"), F.when(fewer, F.col("node")).otherwise(F.col("w")).alias("other"))
    shared = sides.join(graph.near.select("a", "b"), "a").join(graph.near.select(F.col("a").alias("other"), "b"), ["other", "b"], "left_semi").select("w", "node")
    resonant = pairs.select("w", "node").join(graph.res.select(F.col("a").alias("w"), F.col("b").alias("node")), ["w", "node"], "left_semi")
    return shared.unionByName(resonant).distinct()


def going_on(graph: Graph, hop: DataFrame) -> DataFrame:
    """The pairs (w, node) of a first hop (w, node, sure) that are linked: neighbours are looked up for those only that aren't sure."""
    pairs = hop.select("w", "node", "sure").distinct()
    return pairs.where("sure").select("w", "node").unionByName(linked(graph, pairs.where("not sure").select("w", "node")))


def _gate(energy: Column, most: Column) -> Column:
    """How far a context lets a node be excited."""
    return GATE_LOW + (GATE_HIGH - GATE_LOW) * F.coalesce(energy, F.lit(0.0)) / most


def spread(graph: Graph, keyed: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """key, node, energy: the wave of the one word w of each key. keyed: key, w. context: key, node, energy; nodes that a key's context
    holds are let through more, others less; a key without a context is not gated. Words that the graph hasn't excite themselves only."""
    words = keyed.select("w").distinct()
    one = stored(first_hop(graph, words), "first")
    gated = context is not None
    hop = keyed.join(one, "w")
    if gated:
        most = context.groupBy("key").agg(F.greatest(F.max("energy"), F.lit(1e-9)).alias("most"))
        near = context.select("key", "node", F.col("energy").alias("ctx"))
        hop = hop.join(most, "key", "left").join(near, ["key", "node"], "left").withColumn("e", F.col("e") * F.when(F.col("most").isNull(), 1.0).otherwise(_gate(F.col("ctx"), F.col("most")))).drop("ctx")
    # used three times, so written
    hop = stored(hop.select("key", "w", "node", "e", "sure", *(["most"] if gated else [])), "hop")
    order = Window.partitionBy("key").orderBy(F.desc(F.round("e", PLACES)), "node")
    best = hop.where("node <> w").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * SECOND_NODES).select("key", "w", "node", "sure", "rank")
    good = going_on(graph, best)
    chosen = best.join(good, ["w", "node"]).withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("rank"))).where(F.col("k") <= SECOND_NODES).select("key", "node")
    chosen = stored(chosen, "chosen")
    two = chosen.withColumnRenamed("node", "w").join(second_hop(graph, chosen.select(F.col("node").alias("w")).distinct()), "w").select("key", F.col("target").alias("node"), "e")
    if gated:
        two = two.join(most, "key", "left").join(near, ["key", "node"], "left").select("key", "node", (F.col("e") * F.when(F.col("most").isNull(), 1.0).otherwise(_gate(F.col("ctx"), F.col("most")))).alias("e"))
    own = keyed.select("key", F.col("w").alias("node"), F.lit(1.0).alias("e"))
    return own.unionByName(hop.select("key", "node", "e")).unionByName(two).groupBy("key", "node").agg(F.sum("e").alias("energy"))


def activate(graph: Graph, words: DataFrame) -> DataFrame:
    """w, node, energy: each word's own wave. words: w, distinct."""
    return spread(graph, words.select(F.col("w").alias("key"), "w")).withColumnRenamed("key", "w")


def cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, cosine, overlap of two fields with the same keys; 0 where one is empty."""
    norm = lambda d, n: d.groupBy("key").agg(F.sqrt(F.sum(F.col("energy") * F.col("energy"))).alias(n))
    dot = left.join(right.select("key", "node", F.col("energy").alias("other")), ["key", "node"]).groupBy("key").agg(F.sum(F.col("energy") * F.col("other")).alias("dot"), F.count("*").alias("overlap"))
    both = norm(left, "a").join(norm(right, "b"), "key", "full").join(dot, "key", "left")
    big = (F.col("a") >= 1e-9) & (F.col("b") >= 1e-9)
    return both.select("key", F.when(big, F.coalesce("dot", F.lit(0.0)) / (F.col("a") * F.col("b"))).otherwise(0.0).alias("cosine"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def settle(graph: Graph, field: DataFrame, rounds: int = SETTLE_ROUNDS) -> DataFrame:
    """key, node, energy, rounds, converged: the field after its strongest nodes have sent their waves out again, until it hardly changes."""
    live, done = stored(field.select("key", "node", "energy"), "field"), None
    for i in range(1, rounds + 1):
        order = Window.partitionBy("key").orderBy(F.desc(F.round("energy", PLACES)), "node")
        top = live.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SETTLE_TOP)
        top = top.withColumn("most", F.max("energy").over(Window.partitionBy("key"))).select("key", F.col("node").alias("w"), (F.col("energy") / F.col("most") * SETTLE_DECAY**i).alias("scale"))
        top = stored(top.join(graph.damping.select("w"), "w", "left_semi"), "top")
        waves = activate(graph, top.select("w").distinct()).where("node <> w")
        sent = top.join(waves, "w").select("key", "node", (F.col("energy") * F.col("scale")).alias("energy"))
        new = stored(live.unionByName(sent).groupBy("key", "node").agg(F.sum("energy").alias("energy")), "field")
        moved = stored(cosine(live, new).select("key", (1 - F.col("cosine") < SETTLE_EPSILON).alias("converged")), "converged")
        marked = new.join(moved, "key").withColumn("rounds", F.lit(i))
        ends = marked if i == rounds else marked.where("converged")
        done = ends if done is None else done.unionByName(ends)
        live = new.join(moved.where("not converged"), "key", "left_semi")
    return done.select("key", "node", "energy", "rounds", "converged")


def concentration(field: DataFrame, share: float = TOP_SHARE) -> DataFrame:
    """key, n, concentration: how much of a field's energy its strongest fifth of nodes (one at least) holds."""
    w = Window.partitionBy("key")
    ranked = field.select("key", "energy", F.row_number().over(w.orderBy(F.desc("energy"))).alias("rank"), F.count("*").over(w).alias("n"))
    top = F.col("rank") <= F.greatest(F.floor(F.col("n") * F.lit(share)), F.lit(1))
    return ranked.groupBy("key").agg(F.max("n").alias("n"), (F.sum(F.when(top, F.col("energy"))) / F.sum("energy")).alias("concentration"))


def compact_soft_next(graph: Graph, words: DataFrame) -> DataFrame:
    """What may follow `words` (w), lent continuations too, in the compacted graph: 50 successors and 30 partners a word. A common word's successors, which may be most of the vocabulary, would else be lent to every word that resonates with it."""
    nx = stored(g.top(graph.next, g.KEEP["next"]).drop("rank"), "next")
    res = g.top(_of(graph.res, words), g.KEEP["resonance"], weight="resonance").drop("rank")
    return stored(g.soft_next(nx, stored(res, "resonance"), words=words), "soft")


def expected_steps(steps: DataFrame, soft: DataFrame) -> DataFrame:
    """steps (key, pos, prev, w) with seq, how expected w is after prev: 0.4 of its share and 0.6 of its rank among what may follow. soft: a, b, weight (what follows, lent continuations too)."""
    per = soft.join(steps.select(F.col("prev").alias("a")).distinct(), "a", "left_semi")
    w = Window.partitionBy("a")
    ranked = per.select("a", "b", "weight", F.sum("weight").over(w).alias("all"), F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy(F.desc(F.round("weight", PLACES)), "b")) - 1).alias("rank"))
    seq = F.col("weight") / F.greatest("all", F.lit(1.0)) * g.EXPECT_P + (1 - F.col("rank") / F.col("n")) * g.EXPECT_RANK
    known = ranked.select(F.col("a").alias("prev"), F.col("b").alias("w"), seq.alias("seq"))
    return steps.join(known, ["prev", "w"], "left").select("key", "pos", F.coalesce("seq", F.lit(0.0)).alias("seq"))


class Field:
    """The field of one sentence as it is read, and the waves of its words in it. first: a word's [(node, e, linked)]; second: a node's
    [(target, e)]. The field's size and its strongest node are kept along, so a word costs its wave alone."""

    def __init__(self, first: dict, second: dict):
        self.first, self.second = first, second
        self.energy: dict[str, float] = {}
        self.square = self.most = 0.0

    def wave(self, w: str, gated: bool = True) -> dict[str, float]:
        held, most, least, more = self.energy.get, max(self.most, 1e-9), GATE_LOW, GATE_HIGH - GATE_LOW
        gated = gated and bool(self.energy)
        wave, go_on = {w: 1.0}, set()
        for node, e, ok in self.first.get(w, ()):
            if gated:
                e *= least + more * held(node, 0.0) / most
            wave[node] = wave[node] + e if node in wave else e
            if ok:
                go_on.add(node)
        # the first hop's energy alone decides where the second starts
        ranked = sorted([(-round(e, PLACES), n) for n, e in wave.items() if n != w])[: 2 * SECOND_NODES]
        for node in [n for _, n in ranked if n in go_on][:SECOND_NODES]:
            for target, e in self.second.get(node, ()):
                if gated:
                    e *= least + more * held(target, 0.0) / most
                wave[target] = wave[target] + e if target in wave else e
        return wave

    def add(self, wave: dict[str, float]) -> None:
        energy, square, most = self.energy, self.square, self.most
        for n, e in wave.items():
            had = energy.get(n, 0.0)
            energy[n] = now = had + e
            square += now * now - had * had
            if now > most:
                most = now
        self.square, self.most = square, most

    def agreement(self, wave: dict[str, float]) -> float:
        """The cosine of a wave and the field."""
        if self.square <= 1e-18:
            return 0.0
        energy = self.energy
        return sum([e * energy[n] for n, e in wave.items() if n in energy]) / (sum([e * e for e in wave.values()]) ** 0.5 * self.square**0.5)

    def fit(self, w: str) -> float:
        """How well a word would stand here: its wave's agreement and what the field holds of it."""
        return self.agreement(self.wave(w, gated=False)) + self.energy.get(w, 0.0)


def fold(words: list[str], seq: list[float], first: dict, second: dict) -> tuple[list[tuple], dict[str, float]]:
    """One sentence from left to right: the steps (surprise, reinforcement, synchrony) and the field at the end."""
    field, steps = Field(first, second), []
    for i, w in enumerate(words):
        wave = field.wave(w)
        reinforced = synchrony = surprise = 0.0
        if i:
            reinforced, synchrony = min(field.energy.get(w, 0.0) / max(field.most, 1e-9), 1.0), field.agreement(wave)
            surprise = (1 - reinforced) * SURPRISE["wave"] + (1 - seq[i]) * SURPRISE["sequence"] + (1 - synchrony) * SURPRISE["synchrony"]
        steps.append((surprise, reinforced, synchrony))
        field.add(wave)
    return steps, field.energy


def chosen(words: list[str], position: int, candidates: list[str], known: set[str], nearest: dict[str, str], first: dict, second: dict) -> tuple[str, str]:
    """The word for one place, and why. A known word stays. Of the candidates the one that fits the field of the other words best is taken
    if it fits at all, known ones being ahead by a little; else the one whose nearest known word fits best."""
    word = words[position]
    if word in known:
        return word, "already_understood"
    field = Field(first, second)
    for i, w in enumerate(words):
        if i != position:
            field.add(field.wave(w))
    best = _best(candidates, lambda c: field.fit(c) + (KNOWN_BONUS if c in known else 0.0))
    if best and best[1] > NOISE:
        return best[0], "context_aligned"
    best = _best([c for c in candidates if nearest.get(c, c) != c], lambda c: field.fit(nearest[c]))
    if best and best[1] > NOISE:
        return best[0], f"inferred_via_{nearest[best[0]]}"
    return word, "no_alignment"


def _best(candidates: list[str], of) -> tuple[str, float] | None:
    """The candidate with the highest score, the first of equal ones."""
    scored = [(c, of(c)) for c in candidates]
    return max(scored, key=lambda x: round(x[1], PLACES)) if scored else None


def chosen_line(words: list[str], candidates: dict[int, list[str]], known: set[str], nearest: dict[str, str], first: dict, second: dict) -> tuple[list[str], list[tuple]]:
    """A line with all its places chosen from left to right, a choice being part of the next one's context; and the changes (position, from, to, reason)."""
    words, made = list(words), []
    for position in sorted(p for p, c in candidates.items() if c and p < len(words)):
        word, why = chosen(words, position, candidates[position], known, nearest, first, second)
        if word != words[position]:
            made.append((position, words[position], word, why))
            words[position] = word
    return words, made


def read_line(words: list[str], candidates: dict[int, list[str]], known: set[str], nearest: dict[str, str], first: dict, second: dict) -> tuple[list[str], list[tuple]]:
    """A line read from left to right by the field so far. A known word gives way only to a known candidate that fits by a margin; an unknown one to the candidate that fits best, or whose nearest known word does."""
    field, out, made = Field(first, second), [], []
    for i, word in enumerate(words):
        offered, pick, why = candidates.get(i), word, ""
        if offered and word in known:
            if word not in offered:
                own = field.fit(word) + OVERRULE
                # the last one that is better by the margin, in the order in which they are offered
                for c in offered:
                    if c in known and field.fit(c) > own:
                        pick, why = c, "field_prefers"
        elif offered:
            best = _best(offered, lambda c: field.fit(c) + (KNOWN_BONUS if c in known else 0.0))
            if best[1] > NOISE:
                pick, why = best[0], "field_aligned"
            else:
                best = _best([c for c in offered if nearest.get(c, c) != c], lambda c: field.fit(nearest[c]))
                if best and best[1] > NOISE:
                    pick, why = best[0], f"inferred_{nearest[best[0]]}"
        if why:
            made.append((i, word, pick, why))
        out.append(pick)
        field.add(field.wave(pick))
    return out, made


def corrected(words: list[str], seq: list[float], steps: list[tuple], field: dict[str, float]) -> float:
    """The mean surprise once the whole sentence is known: what the end's field holds of a word takes surprise from it, gated by how
    expected it was and by how many of the steps before it (the first not counted) were coherent."""
    most, total, coherent = max([*field.values(), 1e-9]), 0.0, 0
    for i in range(1, len(words)):
        consistency = coherent / (i - 1) if i > 1 else 0.5
        retro = min(field.get(words[i], 0.0) / most, 1.0)
        total += steps[i][0] * (1 - retro * max(seq[i], LEAST_GATE) * (0.4 + consistency * 0.6) * STRENGTH)
        coherent += steps[i][0] < COHERENT_BELOW
    return total / len(words)


def _kits(graph: Graph, words: DataFrame) -> DataFrame:
    """bucket, hop, w, nodes, es, oks: the edges that the waves of each bucket's words (bucket, w) can take, once a bucket."""
    words = stored(words, "words")
    one = stored(first_hop(graph, words.select("w").distinct()), "first")
    one = stored(one.join(going_on(graph, one.where("node <> w")).withColumn("ok", F.lit(True)), ["w", "node"], "left").withColumn("ok", F.coalesce("ok", F.lit(False))), "first")
    of_first = one.groupBy("w").agg(F.collect_list("node").alias("nodes"), F.collect_list("e").alias("es"), F.collect_list("ok").alias("oks"))
    nodes = words.join(one.where("ok").select("w", "node"), "w").select("bucket", F.col("node").alias("w")).distinct()
    of_second = second_hop(graph, one.where("ok").select(F.col("node").alias("w")).distinct()).groupBy("w").agg(F.collect_list("target").alias("nodes"), F.collect_list("e").alias("es"))
    return words.join(of_first, "w").select("bucket", F.lit(1).alias("hop"), "w", "nodes", "es", "oks").unionByName(nodes.join(of_second, "w").select("bucket", F.lit(2).alias("hop"), "w", "nodes", "es", F.lit(None).cast("array<boolean>").alias("oks")))


def _edges_of(kit) -> tuple[dict, dict]:
    """A bucket's kit as dictionaries."""
    first = {r.w: sorted(zip(r.nodes, r.es, r.oks, strict=True)) for r in kit[kit.hop == 1].itertuples()}
    return first, {r.w: sorted(zip(r.nodes, r.es, strict=True)) for r in kit[kit.hop == 2].itertuples()}


def _side_by_side(buckets: int, left: DataFrame, right: DataFrame):
    """Two tables cogrouped by bucket, in a stated number of parts: their bytes are few and the folds dear, so parts aren't to be put together by their size."""
    parts = min(buckets, MOST_PARTS)
    return left.repartition(parts, "bucket").groupBy("bucket").cogroup(right.repartition(parts, "bucket").groupBy("bucket"))


def in_context(graph: Graph, pairs: DataFrame, per_bucket: int = PAIRS_PER_BUCKET) -> DataFrame:
    """a, b, nodes, energies: the wave of b in the context of a's own wave. pairs: a, b, distinct. As `spread` gives it, but a bucket of
    pairs gets the edges of its words once: a context isn't written out, and met with all its nodes, for each pair that it stands before."""
    import pandas as pd

    pairs = stored(pairs.select("a", "b"), "pairs")
    buckets = max(1, -(-pairs.count() // per_bucket))
    # the pairs of one context stay together, so far as they fit
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / (per_bucket // 4 + 1)))
    dealt = stored(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("a", part), F.lit(buckets)).cast("int").alias("bucket")), "dealt")
    kit = _kits(graph, dealt.select("bucket", F.explode(F.array("a", "b")).alias("w")).distinct())

    def waves(part: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        first, second = _edges_of(edges)
        out, before, field = [], None, None
        for a, b in sorted(zip(part.a, part.b, strict=True)):
            if a != before:
                before, field = a, Field(first, second)
                field.add(field.wave(a))
            wave = field.wave(b)
            out.append((a, b, list(wave), list(wave.values())))
        return pd.DataFrame(out, columns=["a", "b", "nodes", "energies"])

    return _side_by_side(buckets, dealt, kit).applyInPandas(waves, "a string, b string, nodes array<string>, energies array<double>")


def choose_lines(graph: Graph, lines: DataFrame, nearest: DataFrame | None = None, reading: bool = False, per_bucket: int = PER_BUCKET) -> DataFrame:
    """key, words, decisions (position, from, to, reason): lines with each offered place chosen in the context of the whole line, or, if
    `reading`, read from left to right by the field so far. lines: key (unique), ws, offers (map from position, from 0, to candidates).
    nearest: word, nearest (a known word), for candidates that nothing aligns."""
    import pandas as pd

    key_type = lines.schema["key"].dataType.simpleString()
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<array<string>>"))
    lines = stored(lines.select("key", F.coalesce("ws", F.array().cast("array<string>")).alias("ws"), F.coalesce("offers", none).alias("offers")), "lines")
    buckets = max(1, -(-lines.count() // per_bucket))
    dealt = lines.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    words = dealt.select("bucket", F.explode(F.array_distinct(F.concat("ws", F.flatten(F.map_values("offers"))))).alias("w")).where("w is not null").distinct()
    via = None
    if nearest is not None:
        via = stored(words.join(nearest.select(F.col("word").alias("w"), "nearest"), "w").select("bucket", "w", "nearest").distinct(), "nearest")
        words = words.unionByName(via.select("bucket", F.col("nearest").alias("w"))).distinct()
    # a word with an edge is known
    kit = _kits(graph, words)
    if via is not None:
        null = lambda kind: F.lit(None).cast(kind)
        kit = kit.unionByName(via.select("bucket", F.lit(0).alias("hop"), "w", F.array("nearest").alias("nodes"), null("array<double>").alias("es"), null("array<boolean>").alias("oks")))
    schema = f"key {key_type}, words array<string>, decisions array<struct<position:int,from:string,to:string,reason:string>>"

    def run(part: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        first, second = _edges_of(edges)
        near = {r.w: r.nodes[0] for r in edges[edges.hop == 0].itertuples()}
        one, out = read_line if reading else chosen_line, []
        for r in part.itertuples():
            offers = {int(p): [c for c in cs if c is not None] for p, cs in dict(r.offers).items() if cs is not None}
            done, made = one(list(r.ws), offers, first.keys(), near, first, second)
            out.append((r.key, done, [{"position": p, "from": a, "to": b, "reason": why} for p, a, b, why in made]))
        return pd.DataFrame(out, columns=["key", "words", "decisions"])

    return _side_by_side(buckets, dealt, kit).applyInPandas(run, schema)


def score(graph: Graph, texts: DataFrame, soft: DataFrame, per_bucket: int = PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """texts (key, ws) scored by folds. Two tables: key, n_words, surprise (mean), coherence, corrected; and the fields at the ends
    (key, node, energy). Texts of fewer than two words score 0 and have no field. key is unique."""
    import pandas as pd

    key_type = texts.schema["key"].dataType.simpleString()
    texts = stored(texts.select("key", "ws"), "texts")
    long = texts.where(F.size("ws") >= 2)
    buckets = max(1, -(-long.count() // per_bucket))
    dealt = long.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    steps = dealt.select("key", F.posexplode(g._pairs(F.col("ws"), 1)).alias("p", "x")).select("key", (F.col("p") + 1).alias("pos"), F.col("x.a").alias("prev"), F.col("x.b").alias("w"))
    seqs = expected_steps(steps, soft).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seq"))), lambda s: s["seq"]).alias("seq"))
    kit = _kits(graph, dealt.select("bucket", F.explode(F.array_distinct("ws")).alias("w")).distinct())

    def folded(sentences: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        first, second = _edges_of(edges)
        out = []
        for r in sentences.itertuples():
            ws, seq = list(r.ws), [0.0, *r.seq]
            found, field = fold(ws, seq, first, second)
            surprise = sum(s[0] for s in found) / len(ws)
            out.append((r.key, len(ws), surprise, 1 - min(surprise, 1), 1 - min(corrected(ws, seq, found, field), 1), list(field), list(field.values())))
        return pd.DataFrame(out, columns=["key", "n_words", "surprise", "coherence", "corrected", "nodes", "energies"])

    both = _side_by_side(buckets, dealt.join(seqs, "key"), kit)
    scored = stored(both.applyInPandas(folded, f"key {key_type}, n_words int, surprise double, coherence double, corrected double, nodes array<string>, energies array<double>"), "scored")
    short = texts.where(F.size("ws") < 2).select("key", F.size("ws").alias("n_words"), *[F.lit(0.0).alias(c) for c in ("surprise", "coherence", "corrected")])
    fields = scored.select("key", F.explode(F.arrays_zip("nodes", "energies")).alias("x")).select("key", F.col("x.nodes").alias("node"), F.col("x.energies").alias("energy"))
    return scored.select("key", "n_words", "surprise", "coherence", "corrected").unionByName(short), fields


def score_settled(graph: Graph, texts: DataFrame, soft: DataFrame, per_bucket: int = PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """As `score`, with settled (0.8 of corrected, 0.2 of the settled field's concentration), rounds and converged, and the settled fields."""
    scores, fields = score(graph, texts, soft, per_bucket)
    settled = stored(settle(graph, fields), "settled")
    ends = settled.groupBy("key").agg(F.first("rounds").alias("rounds"), F.first("converged").alias("converged")).join(concentration(settled), "key")
    both = scores.join(ends, "key", "left")
    value = F.coalesce(F.col("corrected") * (1 - SETTLED_SHARE) + F.col("concentration") * SETTLED_SHARE, F.lit(0.0))
    return both.select("key", "n_words", "surprise", "coherence", "corrected", value.alias("settled"), F.coalesce("rounds", F.lit(0)).alias("rounds"), F.coalesce("converged", F.lit(False)).alias("converged")), settled.select("key", "node", "energy")


def compare_fields(fields: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, similarity, size_left, size_right, overlap: the settled fields of two texts. pairs: left, right (keys of `fields`)."""
    keyed = pairs.select(F.struct("left", "right").alias("key"), "left", "right")
    side = lambda c: keyed.join(fields.withColumnRenamed("key", c), c).select("key", "node", "energy")
    sizes = fields.groupBy("key").agg(F.count("*").alias("n"))
    near = cosine(side("left"), side("right")).select(F.col("key.left").alias("left"), F.col("key.right").alias("right"), F.col("cosine").alias("similarity"), "overlap")
    size = lambda c: sizes.select(F.col("key").alias(c), F.col("n").alias(f"size_{c}"))
    whole = pairs.select("left", "right").join(near, ["left", "right"], "left").join(size("left"), "left", "left").join(size("right"), "right", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return whole.select("left", "right", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), zero("size_left"), zero("size_right"), zero("overlap"))


def verdict(before: Column, after: Column) -> Column:
    """Whether a text's correction is to be accepted, by the corrected coherence of the two."""
    return F.when(after - before > ACCEPT_DELTA, "accept").when(after - before < -ACCEPT_DELTA, "reject").otherwise("neutral")


def best_variant(scored: DataFrame) -> DataFrame:
    """group, best, score, margin: of each group's variants (group, variant, settled) the one that settles best, and how far it is ahead."""
    w = Window.partitionBy("group").orderBy(F.desc(F.round("settled", PLACES)), "variant")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    return ranked.groupBy("group").agg(F.max(F.when(F.col("rank") == 1, F.col("variant"))).alias("best"), F.max("settled").alias("score"), (F.max("settled") - F.min("settled")).alias("margin"))


def words_of(texts: DataFrame) -> DataFrame:
    """The distinct words of texts (ws), as w."""
    return texts.select(F.explode("ws").alias("w")).distinct()
