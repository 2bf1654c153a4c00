import numpy as np
from pyspark.sql import functions as F

from textloom.llm import ann


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16]
    out = {}
    for i, q in ok:
        if i % every == 0:
            out[i] = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i)[:k]
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(8, 16))
    x = centres[r.integers(0, 8, 1500)] + 0.4 * r.normal(size=(1500, 16))
    x[700:1100] = x[700]  # a vector that a quarter of all rows share
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(df, F.col("vec_id") % 25 == 0, trees=12, leaf=32, share=0.5, least=100, block=300).collect()
    want, found = brute(rows, 10, 25), {}
    for g in got:
        found.setdefault(g.query_id, []).append((g.rank, g.score, g.vec_id))
    assert set(found) == set(want)
    hits = 0
    for q, near in found.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, 11))
        assert [(s, v) for _, s, v in near] == sorted((s, v) for _, s, v in near)
        for _, s, v in near:
            assert abs(s - float(np.sqrt(((x[v] - x[q]) ** 2).sum()))) < 1e-12
        hits += len({v for _, _, v in near} & {v for _, v in want[q]})
    assert hits / (10 * len(want)) >= 0.9
    # equal vectors: the smallest ids, at distance 0
    assert [v for _, _, v in sorted(found[750])] == [700 + i for i in range(10)]


def test_defined_cases(spark):
    v = [1.0] * 16
    rows = [(0, v), (1, None), (2, [0.0] * 16), (3, [float("nan")] * 16), (4, [1.0] * 15 + [None]), (5, [float("inf")] * 16), (6, [2.0] * 16), (7, [1.0]), (None, v), (8, [1.5] * 16), (8, [9.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 8, 2.0), (0, 2, 6, 4.0)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0
