from collections import Counter

from pyspark.sql import functions as F

from textloom.operators import graph as g

TEXTS = ["The doctor treats the patient. The physician treats a child! The doctor examines the patient", "Doctor treats patient with medication.\nx. physician examines patient", "", None]


def sents(spark):
    return g.sentences(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


def words():
    import re

    out = []
    for t in TEXTS:
        for s in re.split(r"[.!?\n]+", t or ""):
            w = [x for x in re.findall("[a-z0-9]+", s.strip().lower()) if len(x) > 1]
            if len(s.strip()) > 5 and len(w) >= 2:
                out.append(w)
    return out


def test_counts(spark):
    s, ws = sents(spark), words()
    assert sorted(r.ws for r in s.collect()) == sorted(ws)
    assert {(r.a, r.b): r.n for r in g.next_words(s).collect()} == Counter(p for w in ws for p in zip(w, w[1:], strict=False))
    near = Counter((w[i], w[j]) for w in ws for i in range(len(w)) for j in range(len(w)) if i != j and abs(i - j) <= 3)
    assert {(r.a, r.b): r.n for r in g.near_words(s).collect()} == near
    skip = Counter()
    for w in ws:
        for i in range(len(w)):
            for d in range(2, 8):
                if i + d < len(w):
                    skip[w[i], w[i + d]] += 1 / d
    assert all(abs(skip[r.a, r.b] - r.weight) < 1e-9 for r in g.skip_words(s).collect())


def test_decay_against_a_sequential_run(spark):
    rows = [(i, f"aa{i % 3} bb{i % 5} cc{i % 2} dd") for i in range(57)]
    s = g.sentences(spark.createDataFrame(rows, "doc_id long, text string"))
    weights: Counter = Counter()
    for n, (_, t) in enumerate(rows, 1):
        w = t.split()
        for p in zip(w, w[1:], strict=False):
            weights[p] += 1
        if n % 10 == 0:
            weights = Counter({p: x * 0.5 for p, x in weights.items() if x * 0.5 >= 0.01})
    got = {(r.a, r.b): r.weight for r in g.decayed(s, 10, 0.5).collect()}
    assert set(got) == set(weights) and all(abs(got[p] - weights[p]) < 0.05 for p in got)


def test_numbering_is_the_documents_order(spark):
    s = g.numbered(sents(spark), block=1).orderBy("doc_id", "sid").collect()
    assert [r.ns for r in s] == list(range(1, len(s) + 1))


def test_resonance_is_symmetric_and_finds_slots(spark):
    res = {(r.a, r.b): r.resonance for r in g.batch_resonance(g.next_words(sents(spark))).collect()}
    assert res["doctor", "physician"] > 0 and all(abs(res[b, a] - x) < 1e-12 for (a, b), x in res.items())


def test_known_sentences_are_expected_more(spark):
    s = sents(spark)
    test = spark.createDataFrame([(1, ["the", "doctor", "treats", "the", "patient"]), (2, ["patient", "the", "treats", "doctor"]), (3, ["zzz", "xxx", "yyy"])], "id int, ws array<string>")
    c = {r.id: r.coherence for r in g.coherence(test, g.ranked_next(g.next_words(s)), ["id"]).collect()}
    assert c[1] > c[2] >= c[3] == 0


def test_soft_next_and_median(spark):
    nx = spark.createDataFrame([("a", "x", 3), ("b", "x", 1), ("b", "y", 2)], "a string, b string, n long")
    res = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, resonance double")
    got = {(r.a, r.b): (round(r.weight, 6), r.soft) for r in g.soft_next(nx, res).collect()}
    assert got == {("a", "x"): (3.0, False), ("b", "x"): (1.0, False), ("b", "y"): (2.0, False), ("a", "y"): (round(2 * 0.68, 6), True)}
    assert g.upper_median(spark.createDataFrame([(1,), (2,), (3,), (9,)], "n int"), "n").first().n == 3
    assert g.top(nx, 1).select(F.count("*")).first()[0] == 2
