"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue for all of them, exact reranking.

Fit: `trees` trees are grown on the driver over at most `sample` vectors, chosen by a hash of their id (the documented bound). A node
splits its vectors at the plane between the means of two small random clusters; a node of `leaf` vectors or fewer, or one that won't
split, is a leaf. Index: every row is routed through every tree and stored under its leaves. Search: all trees share one priority
queue, ordered by how far a query is from the wrong side of the planes passed; leaves are taken from it until they hold `share` of the
indexed rows (`least` at least, repeats counted). Rerank: distances to the rows of the taken leaves are computed exactly, in doubles,
on the original vectors, and the nearest kept; ties go to the smaller id.

`share` sets the recall. Vectors without structure, such as the test tables' (64 dimensions, hardly any contrast between near and
far), need a large share; clustered ones a small one. The tests measure recall against brute force.

Plan. A leaf's rows are dealt into blocks of about `block` rows, and the queries into blocks of as many, so a leaf that holds a third of
all rows (equal vectors can't be split) is several tasks' work and no group grows with the data. Each task returns the nearest `k`
a query only, and these lists meet in one aggregation: no table of candidate pairs exists.

Defined cases. Vectors that are null, all zero, hold a null or non-finite component, or haven't the commonest length of the sample take
no part; neither do rows without an id. A row isn't its own neighbour; rows that share an id count as one, the nearest. Fewer than k
candidates: all of them. Empty tables give an empty result. Other columns are dropped.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, LEAF, SAMPLE, SHARE, LEAST, BLOCK, K, EVERY, SEED = 24, 64, 16384, 0.8, 1000, 20_000, 10, 100, 3


class Tree:
    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        normals, offsets, children, self.leaves = [], [], [], 0
        todo, self.root = [(np.arange(len(x)), None, 0)], None
        while todo:
            rows, parent, side = todo.pop()
            split = self._split(x, rows, rng) if len(rows) > leaf else None
            if split is None:
                node = -1 - self.leaves
                self.leaves += 1
            else:
                node = len(normals)
                normals.append(split[0])
                offsets.append(split[1])
                children.append([0, 0])
                todo += [(rows[split[2]], node, 1), (rows[~split[2]], node, 0)]
            if parent is None:
                self.root = node
            else:
                children[parent][side] = node
        self.normals = np.array(normals).reshape(len(normals), x.shape[1])
        self.offsets, self.children = np.array(offsets), np.array(children, int).reshape(-1, 2)

    @staticmethod
    def _split(x, rows, rng):
        for _ in range(5):
            some = x[rng.choice(rows, min(len(rows), 200), replace=False)]
            a, b = some[0], some[-1]
            for _ in range(4):
                near = ((some - a) ** 2).sum(1) < ((some - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = some[near].mean(0), some[~near].mean(0)
            normal = a - b
            if not (size := np.linalg.norm(normal)):
                continue
            normal = normal / size
            offset = normal @ (a + b) / 2
            over = x[rows] @ normal > offset
            if 0.05 < over.mean() < 0.95:
                return normal, offset, over
        return None

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row. Row by row the same sum, so equal vectors always share a leaf."""
        node = np.full(len(x), self.root)
        while len(open_ := np.flatnonzero(node >= 0)):
            at = node[open_]
            over = (x[open_] * self.normals[at]).sum(1) > self.offsets[at]
            node[open_] = self.children[at, over.astype(int)]
        return -1 - node


def forest(x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> list[Tree]:
    return [Tree(x, leaf, np.random.default_rng((seed, i))) for i in range(trees)]


def visit(trees: list[Tree], sizes: list[np.ndarray], q: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """(tree, leaf) from the shared queue, nearest to the planes first, until they hold enough rows."""
    queue = [(-np.inf, i, t.root) for i, t in enumerate(trees)]
    heapq.heapify(queue)
    margins = [t.normals @ q - t.offsets for t in trees]
    taken, held = [], 0
    while queue and held < enough:
        far, i, node = heapq.heappop(queue)
        if node < 0:
            taken.append((i, -1 - node))
            held += int(sizes[i][-1 - node])
            continue
        m = margins[i][node]
        heapq.heappush(queue, (max(far, -m), i, trees[i].children[node, 1]))
        heapq.heappush(queue, (max(far, m), i, trees[i].children[node, 0]))
    return taken


def nearest(ids: np.ndarray, x: np.ndarray, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows' ids and distances; ties to the smaller id."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    own = ids != query
    ids, d = ids[own], d[own]
    if len(d) > k:
        near = d <= np.partition(d, k - 1)[k - 1]
        ids, d = ids[near], d[near]
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda c: c != 0)


def search(vectors: DataFrame, queries: Column, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, share: float = SHARE, least: int = LEAST, block: int = BLOCK, k: int = K, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries` marks (a condition on its column vec_id) its nearest rows."""
    import pandas as pd
    import pyarrow as pa

    from textloom.llm.storage import written

    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    ready = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    chosen = ready.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).toArrow()["v"].to_pylist()
    if not chosen:
        return spark.createDataFrame([], schema)
    width = min(Counter(map(len, chosen)).items(), key=lambda c: (-c[1], c[0]))[0]
    grown = spark.sparkContext.broadcast(forest(np.array([v for v in chosen if len(v) == width]), trees, leaf, seed))  # bounded by sample

    def routed(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            at = np.stack([t.route(x) for t in grown.value], 1).astype("<i4")
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary()), "leaves": pa.array(at.tolist(), pa.list_(pa.int32()))})

    index = written(ready.where(F.size("v") == width).mapInArrow(routed, "vec_id long, x binary, leaves array<int>"), "forest")
    # a count a leaf: at most trees * (2 * sample / leaf or so) numbers
    counts = index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect()
    sizes = [np.zeros(t.leaves, int) for t in grown.value]
    for c in counts:
        sizes[c["tree"]][c["leaf"]] = c["count"]
    n, n_queries = int(sizes[0].sum()), index.where(queries).count()
    enough, q_blocks = max(least, int(np.ceil(share * n))), max(1, -(-n_queries // block))
    buckets = max(24, -(-trees * n * q_blocks // (2 * block)))
    known = spark.sparkContext.broadcast((sizes, [-(-s // block) for s in sizes]))
    place = lambda tree, at, part, q_part: ((int(tree) * 1_000_003 + int(at)) * 8191 + part * 127 + q_part) * 2_654_435_761 % (1 << 61) % buckets
    mixed = lambda i: (int(i) * 0x9E3779B97F4A7C15 >> 20) & 0xFFFFFFFF

    def rows_out(pieces):
        ids, xs, tree, at, part, bucket = ([] for _ in range(6))
        for i, x, t, a, p, b in pieces:
            for out, value in zip((ids, xs, tree, at, part, bucket), (i, x, t, a, p, b), strict=True):
                out.append(value)
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "x": pa.array(xs, pa.binary()), "leaf": pa.array([t << 32 | a for t, a in zip(tree, at, strict=True)], pa.int64()), "part": pa.array(part, pa.int64()), "bucket": pa.array(bucket, pa.int64())})

    def stored(batches):
        parts = known.value[1]
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                yield rows_out((i, x, t, a, p := mixed(i) % int(parts[t][a]), place(t, a, p, q)) for i, x, at in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True) for t, a in enumerate(at) for q in range(q_blocks))

    def asked(batches):
        sizes, parts = known.value
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                some = b.slice(lo, 100)
                yield rows_out(
                    (i, x, t, a, p, place(t, a, p, mixed(i) % q_blocks))
                    for i, x in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)
                    for t, a in visit(grown.value, sizes, np.frombuffer(x), enough)
                    for p in range(int(parts[t][a]))
                )

    def reranked(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asks.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, x = rows["id"].to_numpy(), np.frombuffer(b"".join(rows["x"])).reshape(-1, width)
        groups = rows.groupby(["leaf", "part"]).indices
        best: dict[tuple[int, bytes], list] = {}
        for query, qx, leaf_, part in zip(asks["id"], asks["x"], asks["leaf"], asks["part"], strict=True):
            found = groups.get((leaf_, part))
            if found is not None:
                best.setdefault((query, qx), []).append(found)
        out = []
        for (query, qx), found in best.items():
            at = np.unique(np.concatenate(found))
            near, d = nearest(ids[at], x[at], query, np.frombuffer(qx), k)
            out.append(pd.DataFrame({"query_id": query, "vec_id": near, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    piece = "id long, x binary, leaf long, part long, bucket long"
    left, right = index.mapInArrow(stored, piece).groupBy("bucket"), index.where(queries).mapInArrow(asked, piece).groupBy("bucket")
    found = left.cogroup(right).applyInPandas(reranked, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)
