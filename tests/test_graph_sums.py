from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import graph as g

SENTS = [["to", "be", "or", "not", "to", "be"], ["to", "to", "to", "be"], ["éa", "be"]]


def test_near_words_stand_both_ways_and_are_counted_once(spark):
    s = spark.createDataFrame([(i, 0, ws) for i, ws in enumerate(SENTS)], "doc_id long, sid int, ws array<string>")
    want = Counter((ws[i], ws[j]) for ws in SENTS for i in range(len(ws)) for j in range(len(ws)) if 0 < abs(i - j) <= 3)
    near = g.near_words(s)
    assert {(r.a, r.b): r.n for r in near.collect()} == want
    degree, freq = near.groupBy(F.col("a").alias("w")).agg(F.count("*").alias("degree")), g.tokens(s).groupBy("w").agg(F.count("*").alias("n"))
    out = g.inhibition(freq, degree)
    assert "generate" not in out._jdf.queryExecution().toString().lower()  # the medians and the weights don't count the graph anew
    assert {r.w: (r.n, r.degree) for r in out.collect()} == {w: (n, len({b for a, b in want if a == w})) for w, n in Counter(w for ws in SENTS for w in ws).items()}


def test_form_is_made_once_and_right(spark):
    words = ["a", "b", "io", "strength", "banana", "aeiouaeiou", "x1y0a", "queueing", "rhythms", "abababab"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", g.form_vector(F.col("w")).alias("v"))
    # the pattern stood in the plan for each number, and was made again for each place
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2 and plan.count("split(") <= 3
    for r in df.collect():
        w, n = r.w, len(r.w)
        v = [int(c in "aeiou") for c in w]
        s = [2 * x - 1 for x in v]
        runs = lambda x: max(map(len, "".join(map(str, v)).split(str(1 - x)))) / n  # noqa: E731, B023
        pairs = lambda *ps: sum((x, y) in ps for x, y in zip(v, v[1:], strict=False)) / (n - 1) if n > 1 else 0  # noqa: E731, B023
        three = lambda t: sum(u == t for u in zip(v, v[1:], v[2:], strict=False)) / (n - 2) if n > 2 else 0  # noqa: E731, B023
        mean, third = sum(s) / n, n // 3
        ends = sum(s[2 * third :]) / len(s[2 * third :]) - sum(s[:third]) / third if n > 2 else 0
        want = [pairs((0, 1), (1, 0)), runs(0), runs(1), s[0], s[-1], ends, sum(v) / n, (sum((x - mean) ** 2 for x in s) / n) ** 0.5, pairs((0, 1)), pairs((1, 0)), pairs((0, 0)), pairs((1, 1)), three((0, 1, 0)), three((1, 0, 1)), len(set(w)) / n, min(n / 15, 1)]
        assert r.v == pytest.approx(want, abs=1e-9), w


def test_followers_are_counted_once(spark):
    sents = [*SENTS, ["be", "to", "see", "to"], ["to", "x1"], ["to", "x2"], ["to", "x2"], ["q", "q", "q"]]
    out = g.follow_sums(spark.createDataFrame([(i, 0, ws) for i, ws in enumerate(sents)], "doc_id long, sid int, ws array<string>"))
    # the pairs were counted for each of four parts
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") + out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    n = Counter(p for ws in sents for p in zip(ws, ws[1:], strict=False))
    for r in out.collect():
        f, p = sorted((k for (a, _), k in n.items() if a == r.w), reverse=True), [k for (_, b), k in n.items() if b == r.w]
        want = (sum(f), len(f), max(f, default=0), sum(f[:3]), sum(p), len(p), max(p, default=0), sum(a == r.w and (b, a) in n for a, b in n))
        assert (r.ftot, r.fn, r.ftop, r.ftop3, r.ptot, r.pn, r.ptop, r.inter) == want, r.w
    assert out.count() == len({w for p in n for w in p})
