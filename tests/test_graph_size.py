"""What the graph's queries shuffle."""

import pytest

from textloom.operators import graph as g
from textloom.plans import graph_queries as q

TEXTS = [(1, "the red fox saw the old dog. red dog the fox"), (2, "old fox and old dog. the old fox and the dog"), (None, "red fox red fox. no fox red")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("size"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_neighbours_of_places_are_not_shuffled(spark, folder):
    df = q.neighborhood_volatility(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "hashpartitioning(doc_id#" in plan and ", w#" not in "".join(x.split("Exchange", 1)[1] for x in plan.splitlines() if "Exchange hashpartitioning(doc_id" in x)
    seen, out = {}, {}
    for doc, text in TEXTS:
        for sentence in text.split("."):
            ws = sentence.split()
            for i, w in enumerate(ws):
                near = set(ws[max(0, i - 3) : i] + ws[i + 1 : i + 4])
                if (doc, w) in seen:
                    out.setdefault(w, []).append(1 - len(near & seen[doc, w]) / len(near | seen[doc, w]))
                seen[doc, w] = near
    assert {r.w: (r.n, r.volatility) for r in df.collect()} == {w: (len(v), pytest.approx(sum(v) / len(v), abs=1e-6)) for w, v in out.items()}


def test_pairs_are_counted_once_for_all_tables(spark, folder):
    s = q._sents(spark, folder)
    pairs = g.pair_counts(s)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    rows, both = pairs.collect(), lambda r: {(r.x, r.y), (r.y, r.x)}
    of = lambda df: {(r.a, r.b) for r in df.collect()}
    nx, near, skip = g.next_words(s), g.near_words(s), g.skip_words(s)
    assert {(r.a, r.b, r.n) for r in g.directed(pairs).collect()} == {(r.a, r.b, r.n) for r in nx.collect()}
    assert set().union(*[both(r) for r in rows if r.near]) == of(near)
    assert {(r.x, r.y) for r in rows if r.skip} | {(r.y, r.x) for r in rows if r.back} == of(skip)
    counts = {r["name"]: r["value"] for r in q.graph_stats(spark, folder).collect()}
    assert (counts["transitions"], counts["cooccurrences"], counts["skip_grams"]) == (len(of(nx)), len(of(near)), len(of(skip))) and len(counts) == 8
    degrees = {}
    for edges, end, part in ((of(nx), 0, 1), (of(nx), 1, 1), (of(skip), 1, 0.5), (of(near), 0, 0.3), (of(g.batch_resonance(nx)), 0, 0.5)):
        for e in edges:
            degrees[e[end]] = degrees.get(e[end], 0) + part
    assert {r.w: r.richness for r in q.meaning_richness(spark, folder).collect()} == {w: pytest.approx(x, abs=1e-4) for w, x in degrees.items()}


def test_sizes_of_an_empty_graph(spark, tmp_path):
    spark.createDataFrame([(1, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["name"]: r["value"] for r in q.graph_stats(spark, str(tmp_path)).collect()} == dict.fromkeys(("vocabulary", "mature", "bigrams", "transitions", "cooccurrences", "trajectories", "skip_grams", "resonance_pairs"), 0)


def test_wave_activation_reads_written_tables(spark, folder):
    """No sentence is taken apart again for each kind of edge: what was shuffled for one is gone before the next."""
    df = q.wave_activation(spark, folder)
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == 8
