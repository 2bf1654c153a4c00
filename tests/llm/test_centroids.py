import hashlib
import math

import numpy as np
import pytest

from textloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int, sums string, id string"


def brute(rows, k, rounds, seed, dim, scale):
    """Lloyd's rounds in Python's own integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda v: min((d2(v, m), n) for n, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == n]
            if mine:
                c[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    return sorted(((i, n, d, sum(e for _, e, m in found if m == n), sum(e for _, e, _ in found), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "c", 1, "s", "i") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in centroids.cluster(df, **how).collect()), key=str)


@pytest.mark.parametrize("groups", [1, 2, 3, 5])
def test_against_plain_rounds(spark, groups):
    rng = np.random.default_rng(groups)
    middles = rng.normal(size=(6, 4))
    rows = [(i, [float(x) for x in middles[i % 6] + rng.normal(size=4) * 0.4]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(150)]  # a third of the vectors are equal
    rows += [(1, rows[2][1]), (None, rows[3][1]), (900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 2.0, 3.0]), (904, [1.0, float("inf"), 2.0, 3.0]), (905, [0.0] * 4), (906, [])]
    how = dict(k=5, rounds=6, seed=3, dim=4, scale=16)
    got = run(spark, rows, groups=groups, **how)
    assert got == brute(rows, **how) and len(got) == 453


def test_ties_few_vectors_huge_components(spark):
    how = dict(k=3, rounds=4, seed=3, dim=2, scale=4)
    ties = [(i, [float(i % 3), 0.0]) for i in range(12)] + [(50 + i, [0.5, 0.0]) for i in range(5)]
    for rows in (ties, ties[:2], [(1, [1.0, 1.0])] * 4, [(i, [float(x) * 1e12 for x in (i, i * i % 7)]) for i in range(9)]):
        got, want = run(spark, rows, **how), brute(rows, **how)
        most = centroids.LONG
        assert got == sorted(((i, n, min(d, most), min(a, most) if a <= most else most, min(b, most), h) for i, n, d, a, b, h in want), key=str)
    assert run(spark, [], **how) == [] == run(spark, [(1, None)], **how)


def test_bounds_save_distances():
    """The bounds change nothing, and with vectors in clusters most distances are never computed."""
    rng = np.random.default_rng(5)
    x = np.floor(np.repeat(rng.normal(size=(20, 8)) * 4000, 100, axis=0) + rng.normal(size=(2000, 8)) * 100).astype(np.int64)
    c = x[::100].copy()
    group = centroids.grouped(c, 4)
    b = centroids.Bounds(x, None, None, None, c, None, group)
    first = b.computed
    for _ in range(4):
        moved = np.array([x[b.cluster == k].sum(0) // max((b.cluster == k).sum(), 1) if (b.cluster == k).any() else c[k] for k in range(len(c))])
        b = centroids.Bounds(x, b.cluster, b.upper, b.lower, moved, c, group)
        c = moved
        assert (b.cluster == np.argmin([((x - m) ** 2).sum(1) for m in c], axis=0)).all()
        assert b.computed < first / 4


def test_query_columns(spark):
    out = centroids.op11_centroids(spark, "/root/testdata/sf0.001")
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, 8, 10, 3, 64, 1024)
