import pytest
from pyspark.sql import functions as F

from tests.wave_brute import Net
from textloom.operators import graph as g
from textloom.operators import waves

CORPUS = """doctor treats patient with medication
physician treats patient with care
doctor examines patient in ward
physician examines child in clinic
nurse gives medication to patient
nurse helps doctor in ward
patient takes medication after meal
child takes syrup after meal
doctor prescribes medication for patient
physician prescribes syrup for child
the patient and the child rest in the ward
the nurse and the doctor and the physician work""".split("\n")


@pytest.fixture(scope="module")
def net():
    return Net([s.split() for s in CORPUS])


@pytest.fixture(scope="module")
def graph(spark):
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(CORPUS)], "doc_id long, text string")
    return waves.build(g.sentences(docs))


def fields(df, key="key"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], {})[r.node] = r.energy
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_activate(spark, graph, net):
    words = [*net.freq, "unheard"]
    net.damp["unheard"] = 1.0
    got = fields(waves.activate(graph, spark.createDataFrame([(w,) for w in words], "w string")), "w")
    same(got, {w: net.wave(w) for w in words})
    assert got["unheard"] == {"unheard": 1.0} and max(map(len, got.values())) > 20


def test_in_context(spark, graph, net):
    pairs = [(a, b) for a in ("doctor", "the", "syrup") for b in ("patient", "ward", "meal")]
    keyed = spark.createDataFrame([(f"{a} {b}", b) for a, b in pairs] + [("none", "patient")], "key string, w string")
    contexts = {f"{a} {b}": net.wave(a) for a, b in pairs}
    context = spark.createDataFrame([(k, n, e) for k, f in contexts.items() for n, e in f.items()], "key string, node string, energy double")
    got = fields(waves.spread(graph, keyed, context))
    same(got, {f"{a} {b}": net.wave(b, net.wave(a)) for a, b in pairs} | {"none": net.wave("patient")})


def test_settle(spark, graph, net):
    words = list(net.freq)
    start = waves.activate(graph, spark.createDataFrame([(w,) for w in words], "w string")).withColumnRenamed("w", "key")
    out = waves.settle(graph, start).cache()
    want = {w: net.settle(net.wave(w)) for w in words}
    same(fields(out), {w: f for w, (f, _, _) in want.items()})
    assert {(r.key, r.rounds, r.converged) for r in out.select("key", "rounds", "converged").distinct().collect()} == {(w, i, c) for w, (_, i, c) in want.items()}


TEXTS = {"known": "doctor treats patient with medication", "reversed": "medication with patient treats doctor", "soup": "meal the ward with and", "noise": "zzzzz xxxxx yyyyy", "wrong": "doctor treats medication", "twice": "the patient and the patient and the patient", "one": "doctor", "none": ""}


@pytest.mark.parametrize("per_bucket", [2000, 2])
def test_scores(spark, graph, net, per_bucket):
    texts = spark.createDataFrame([(k, t.split()) for k, t in TEXTS.items()], "key string, ws array<string>")
    net.damp |= {w: 1.0 for t in TEXTS.values() for w in t.split() if w not in net.freq}
    scores, ends = waves.score_settled(graph, texts, g.soft_next(graph.next, graph.res), per_bucket)
    got, want = {r.key: tuple(r)[1:] for r in scores.collect()}, {k: net.score(t.split()) for k, t in TEXTS.items() if k not in ("one", "none")}
    for k, (values, _) in want.items():
        assert got[k] == pytest.approx(values, abs=1e-9), k
    assert got["one"] == (1, 0, 0, 0, 0, 0, False) and got["none"] == (0, 0, 0, 0, 0, 0, False)
    same(fields(ends), {k: end for k, (_, end) in want.items()})
    # what was learnt beats the same words reversed, in a heap, and noise, by every measure
    for i in (2, 3, 4):
        assert got["known"][i] > got["reversed"][i] and got["known"][i] > got["noise"][i] and got["known"][i] > got["soup"][i]
    pairs = [("known", "wrong"), ("known", "noise"), ("known", "known"), ("one", "known")]
    near = {(r.left, r.right): tuple(r)[2:] for r in waves.compare_fields(ends, spark.createDataFrame(pairs, "left string, right string")).collect()}
    for a, b in pairs[:3]:
        x, y = want[a][1], want[b][1]
        assert near[a, b] == pytest.approx((net.cosine(x, y), len(x), len(y), len(x.keys() & y.keys())))
    assert near["one", "known"] == (0.0, 0, len(want["known"][1]), 0)


def test_verdict_and_variants(spark):
    df = spark.createDataFrame([(0.5, 0.6), (0.6, 0.5), (0.5, 0.5005)], "a double, b double")
    assert [r.v for r in df.select(waves.verdict(F.col("a"), F.col("b")).alias("v")).collect()] == ["accept", "reject", "neutral"]
    df = spark.createDataFrame([(1, "x", 0.4), (1, "y", 0.7), (1, "z", 0.5), (2, "only", 0.1), (3, "b", 0.2), (3, "a", 0.2)], "group int, variant string, settled double")
    assert {r.group: (r.best, r.score, pytest.approx(r.margin)) for r in waves.best_variant(df).collect()} == {1: ("y", 0.7, 0.2), 2: ("only", 0.1, 0.0), 3: ("a", 0.2, 0.0)}


def test_empty(spark, graph):
    none = spark.createDataFrame([], "key string, ws array<string>")
    scores, ends = waves.score_settled(graph, none, g.soft_next(graph.next, graph.res))
    assert scores.count() == 0 == ends.count()


LINES = [
    ("doctor treats pat1ent with medication", {2: ["patient", "parent", "ward"]}),
    ("nurse glves medication to patlent", {1: ["gives", "gloves"], 4: ["patient", "patent"]}),
    ("doctor treats patient", {1: ["meal", "ward"]}),
    ("doctor treats medication", {2: ["patient", "doctor"], 0: []}),
    ("qqqq wwww", {0: ["zzzz", "yyyy"], 1: ["zzzz"]}),
    ("chi1d takes syrup", {0: ["chld", "chilb"]}),
    ("the ward the ward meal", {4: ["ward", "the"]}),
    ("", {}),
]


@pytest.mark.parametrize("reading", [False, True])
def test_choose_and_read(spark, graph, net, reading):
    nearest = {"zzzz": "rest", "chilb": "child", "chld": "clinic"}
    rows = [(i, t.split(), o) for i, (t, o) in enumerate(LINES)] + [(98, None, None)]
    df = spark.createDataFrame(rows, "key int, ws array<string>, offers map<int,array<string>>")
    near = spark.createDataFrame(list(nearest.items()), "word string, nearest string")
    got = {r.key: r for r in waves.choose_lines(graph, df, near, reading, per_bucket=3).collect()}
    net.damp |= {w: 1.0 for w in ("zzzz", "yyyy", "qqqq", "wwww", "chld", "chilb", "chi1d", "parent", "gloves", "patent", "pat1ent", "patlent", "glves")}
    for i, (t, o) in enumerate(LINES):
        want = (net.read if reading else net.choose_line)(t.split(), o, nearest)
        assert got[i].words == want, t
        assert {d.position for d in got[i].decisions} >= {p for p, (a, b) in enumerate(zip(t.split(), want, strict=True)) if a != b}
    assert got[98].words == [] and got[0].words[2] == "patient"


def test_buckets_are_folded_by_several_tasks(spark, graph):
    rows = [(f"k{i}", CORPUS[i % len(CORPUS)].split(), {}) for i in range(48)]
    lines = spark.createDataFrame(rows, "key string, ws array<string>, offers map<int,array<string>>")
    done = waves.choose_lines(graph, lines, per_bucket=4)
    # parts of few bytes were put together, so that one task folded all buckets
    assert len({r.part for r in done.select(F.spark_partition_id().alias("part")).collect()}) > 1
    # no stated size of a bucket: 200 sentences were one bucket
    texts = spark.createDataFrame([(f"k{i}", CORPUS[i % len(CORPUS)].split()) for i in range(200)], "key string, ws array<string>")
    parts = []
    side_by_side = waves._side_by_side
    try:
        waves._side_by_side = lambda buckets, *sides: parts.append(buckets) or side_by_side(buckets, *sides)
        scores, _ = waves.score(graph, texts, g.soft_next(graph.next, graph.res))
    finally:
        waves._side_by_side = side_by_side
    assert parts == [4] and scores.count() == 200


def test_links_are_looked_up_for_few_pairs(spark):
    """Two words alone in a sentence, words seven apart, and words that are alone here and in company there."""
    rows = [["lone", "pair"], ["lone", "some"], ["lone", "some", "more"], ["s1", "s2", "s3", "s4", "s5", "s6", "s7", "s8", "s9"], ["same", "same"], ["pair", "x1", "x2"]]
    graph = waves.build(spark.createDataFrame([(i, 0, ws) for i, ws in enumerate(rows)], "doc_id long, sid int, ws array<string>"))
    hop = waves.first_hop(graph).where("node <> w").cache()
    pairs = lambda d: {(r.w, r.node) for r in d.collect()}
    asked, linked = [], waves.linked
    try:
        waves.linked = lambda graph, p: asked.append(pairs(p)) or linked(graph, p)
        got = pairs(waves.going_on(graph, hop))
    finally:
        waves.linked = linked
    assert got == pairs(linked(graph, hop.select("w", "node"))) and ("lone", "some") in got and ("s1", "s8") not in got and ("s1", "s7") in got
    # all pairs were looked up
    assert asked == [{("lone", "pair"), ("pair", "lone"), ("lone", "some"), ("some", "lone"), ("s1", "s8"), ("s2", "s9")}]


@pytest.mark.parametrize("per_bucket", [4096, 5])
def test_in_context_by_bucket(spark, graph, net, per_bucket):
    words = ["doctor", "the", "syrup", "patient", "ward", "meal", "unheard"]
    net.damp["unheard"] = 1.0
    pairs = [(a, b) for a in words for b in words]
    got = {(r.a, r.b): dict(zip(r.nodes, r.energies, strict=True)) for r in waves.in_context(graph, spark.createDataFrame(pairs, "a string, b string"), per_bucket).collect()}
    same(got, {(a, b): net.wave(b, net.wave(a)) for a, b in pairs})
    assert waves.in_context(graph, spark.createDataFrame([], "a string, b string")).count() == 0
