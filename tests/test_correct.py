import random

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import correct

FOLD = str.maketrans("013568i", "olesgbl")


def form(w):
    return "".join(c for c in w.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789").translate(FOLD)


def cuts(f):
    return {f[:i] + f[i + 1 :] for i in range(len(f))} - {""}


def brute(queries, words, spread, limit):
    out = set()
    for q in set(queries):
        found, qf = [], form(q)
        for w in set(words):
            wf, d = form(w), abs(len(q) - len(w))
            ends = d <= spread and len(w) >= 1 and (qf[:2] == wf[:2] or qf[-2:] == wf[-2:])
            if d <= spread + 1 and (ends or qf == wf != "" or (cuts(qf) | {qf}) & cuts(wf)):
                score = 3.0 * (q[:1] == w[:1]) + 2.0 * (q[-1:] == w[-1:]) + 2.0 * (qf[:2] == wf[:2]) + 1.0 * (qf[-2:] == wf[-2:]) - 0.75 * d
                found.append((-score, w))
        out |= {(q, w, -s) for s, w in sorted(found)[:limit]}
    return out


def test_candidates(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeno1t") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["-", "a-b", "é", "aé"]
    queries = ["".join(rng.choice("aeno1t") for _ in range(rng.randint(1, 7))) for _ in range(150)] + ["", "-", "zzz", "aé", None]
    v, q = spark.createDataFrame([(w,) for w in [*words, None]], "word string"), spark.createDataFrame([(x,) for x in queries], "query string")
    for spread, limit in ((1, 3), (2, 20), (1, 768)):
        got = {(r.query, r.word, r["shape"]) for r in correct.candidates(q, v, spread, limit).collect()}
        assert got == brute([x for x in queries if x is not None], words, spread, limit)


def test_common_ends_meet_by_outline(spark):
    """3,000 words of one ending and length are 9,000,000 pairs, of which 5 a query are asked for: words of one outline share theirs."""
    v = spark.range(3000).select(F.concat(F.lit("ab"), F.translate(F.lpad(F.col("id").cast("string"), 4, "0"), "0123456789", "acdfhjkmnp"), F.lit("ing")).alias("word"))
    o = v.withColumn("o", correct.outline(F.col("word"), tx.index_form(F.col("word"))))
    best = correct.best_by_outline(o, o, 1, 5).collect()
    assert len(best) == 1 and [x.word for x in best[0].best] == sorted(r.word for r in v.collect())[:5]
    got = correct.candidates(v.withColumnRenamed("word", "query").limit(50), v, 1, 5)
    assert got.count() == 250
