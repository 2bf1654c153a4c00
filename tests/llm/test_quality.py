import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import quality as q


def corpus(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 8)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randrange(5, 80))]
        good = i % 4 != 0
        if not good:
            w = [f"{x}{r.choice(['***', '$$$', '&&&'])}" for x in w] if i % 8 else [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), len(" ".join(w))))
        labels.append((i, int(good)))
    return docs, labels


def test_identity_against_all_pairs():
    r = np.random.default_rng(0)
    m = q.FactorisationMachine(30, 4)
    m.w0, m.w, m.v = np.float32(0.3), r.normal(size=30).astype(np.float32), r.normal(size=(30, 4)).astype(np.float32)
    ids, x = np.array([2, 5, 9, 11]), np.array([1.0, 0.5, -2.0, 3.0], np.float32)
    want = m.w0 + (m.w[ids] * x).sum() + sum((m.v[a] @ m.v[b]) * x[i] * x[j] for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j)
    assert abs(m.margin(ids, x) - want) < 1e-3


def test_held_out_accuracy(spark):
    docs, labels = corpus(600)
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long").repartition(3)
    model = q.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = q.classify(d, model).join(spark.createDataFrame(labels, "doc_id long, quality int"), "doc_id").where("held_out").collect()
    assert len(got) > 60 and sum(r.predicted == r.quality for r in got) / len(got) > 0.97
    again = {r.doc_id: r.score for r in q.classify(d.repartition(2), model).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_held_out_rows_are_not_fitted_on(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    l = spark.createDataFrame(labels, "doc_id long, quality int")
    flipped = l.withColumn("quality", F.when(q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = q.fit(d, l), q.fit(d, flipped)
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_defined_cases(spark):
    docs, labels = corpus(40)
    rows = [*docs, (1000, None, None), (1001, "", 0), (1002, "x " * 100_000, 1), (None, "a b", 1), (5, docs[5][1], docs[5][2])]
    d = spark.createDataFrame([(*r, "own", 7) for r in rows], "doc_id long, text string, n_chars long, score string, `odd name` int")
    l = spark.createDataFrame([*labels, (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = q.fit(d, l)
    got = q.classify(d, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert q.accepted(d, model).columns == d.columns and set(q.accepted(d, model).select("score").distinct().toPandas().score) <= {"own"}
    assert q.classify(d.limit(0), model).count() == 0
    for few in (l.limit(0), l.where("quality = 1")):
        scores = {r.score for r in q.classify(d, q.fit(d, few)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1


def test_accepted_keeps_any_columns(spark):
    docs, labels = corpus(200)
    names = ["__score", "__held_out", "__predicted", "score", "a.b", "a`b", "ROW", "Predicted"]
    wide = spark.createDataFrame([(*d, *(f"{n} of {d[0]}" for n in names)) for d in docs], ["doc_id", "text", "n_chars", *names])
    model = q.fit(wide.select("doc_id", "text", "n_chars"), spark.createDataFrame(labels, "doc_id long, quality int"))
    out = q.accepted(wide, model)
    assert out.columns == wide.columns
    rows = out.collect()
    assert 0 < len(rows) < 200 and all(tuple(r)[3:] == tuple(f"{n} of {r.doc_id}" for n in names) for r in rows)
    scored = q.classify(wide, model)
    assert [c for c in scored.columns if c in ("score", "Predicted")] == ["score"] and scored.select("`a.b`").count() == 200
    assert {r.doc_id for r in rows} == {r.doc_id for r in q.classify(wide.select("doc_id", "text", "n_chars"), model).where("predicted = 1").collect()}
