"""What the language graph makes once, and for the words asked for only."""

from textloom.operators import graph as g
from textloom.operators import waves

TEXTS = [(1, "The red fox saw the old dog. A   b!  The red dog saw the red fox again\nx y"), (2, "the fox and the dog and the fox and the old red dog"), (3, None), (4, "  one two ﻿. short")]


def _sents(spark):
    return g.sentences(spark.createDataFrame(TEXTS, "doc_id long, text string"))


def test_tokens_are_made_once(spark):
    plan = _sents(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "regexp_replace" not in plan
    rows = {(r.doc_id, r.sid): r.ws for r in _sents(spark).collect()}
    assert rows[1, 0] == ["the", "red", "fox", "saw", "the", "old", "dog"] and rows[4, 0] == ["one", "two"] and not any(k[0] == 3 for k in rows)
    assert (1, 1) not in rows and (1, 3) not in rows and len(rows[2, 0]) == 13


def test_resonance_is_summed_once(spark):
    res = g.batch_resonance(g.next_words(_sents(spark)))
    plan = res._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [" in line and "sum(n" in line for line in plan.splitlines()) == 1
    rows = {(r.a, r.b): r.resonance for r in res.collect()}
    assert rows and all(rows[b, a] == x and a != b for (a, b), x in rows.items())


def test_skip_grams_of_the_words_asked_for(spark):
    graph = waves.build(_sents(spark))
    words = spark.createDataFrame([("fox",), ("red",), ("none",)], "w string")
    every = {(r.a, r.b): r.weight for r in graph.skip().collect()}
    assert {(r.a, r.b): r.weight for r in graph.skip(words).collect()} == {k: x for k, x in every.items() if k[0] in ("fox", "red")}
