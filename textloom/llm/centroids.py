"""Centroid clustering in whole numbers, with Yinyang bounds: exactly Lloyd's rounds, most distances never computed.

The centroids are dealt into groups once, before the first round. Beside its cluster each vector keeps an upper bound of the distance
to its own centroid and, for each group, one lower bound of the distances to the group's other centroids. When the centroids have
moved, the upper bound grows by the own centroid's step and each lower bound shrinks by the longest step in its group. Then

* globally: a vector whose upper bound lies under all its lower bounds keeps its centroid, after the upper bound has been made exact
  at need;
* by group: of the others, groups whose lower bound lies above the exact distance are passed over;
* the centroids of the remaining groups are scanned exactly, which makes those groups' bounds exact again.

Distances are compared as squared whole numbers, so ties go to the smaller number. Bounds are doubles and rounded outwards; a bound
that only equals a distance never passes a centroid over.

Plan. A round is one pass over the vectors, without a shuffle: each task reads its vectors with their bounds, writes them anew, and
beside them one row a batch with the clusters' sums. The driver adds up these sums as a Spark aggregation of k x dim numbers; nothing
else reaches it. The tables of two rounds exist at a time, in the shared folder, so a lost executor costs its tasks only.

Defined cases. Vectors that are null, of another length, or hold null or non-finite components take no part. Of k or fewer kept
vectors each starts a centroid. Rows that repeat an id are vectors of their own; those with a null id start a centroid only if there
are too few others. Components beyond +-2^62 after scaling count as +-2^62, distances beyond 2^63 - 1 are reported as that. An empty
table gives an empty result. The input's other columns are dropped, so their names can't clash.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.storage import dropped, written

K, ROUNDS, SEED, DIM, SCALE = 8, 10, 3, 64, 1024
#: Up to here the squares of 64-bit numbers and their sums over 2,000 components stay exact; beyond, Python's own integers are used.
PLAIN, MOST, LONG = 1 << 25, 1 << 62, (1 << 63) - 1
#: Bounds are widened by this share of their size: far more than a double's rounding, far less than any gain.
SLACK = 1e-12


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """id, v (array<long>): floor(scale * x) of the vectors with `dim` components, all finite."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # the case keeps null and other vectors from the functions beside it, in whatever order conditions are evaluated
    ints = F.when((F.size(vector_col) == dim) & ~bad, F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long")))
    return vectors.select(F.col(id_col).alias("id"), ints.alias("v")).where("v is not null")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:id`; k x dim numbers."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to c."""
    if x.dtype != object and len(c) and np.abs(c.astype(object)).max() >= PLAIN:
        x = x.astype(object)
    d = x - c.astype(x.dtype)
    return (d * d).sum(axis=1)


def root(d2) -> np.ndarray:
    return np.sqrt(np.asarray(d2, dtype=object).astype(float)) if getattr(d2, "dtype", None) == object else np.sqrt(d2)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """Each centroid's group: a few rounds of plain means over the centroids themselves."""
    c = centroids.astype(float)
    groups = max(1, min(groups, len(c)))
    seeds = [0]
    while len(seeds) < groups:
        seeds.append(int(np.argmax(np.min([((c - c[s]) ** 2).sum(1) for s in seeds], axis=0))))
    middles = c[seeds]
    for _ in range(5):
        of = np.argmin([((c - m) ** 2).sum(1) for m in middles], axis=0)
        middles = np.array([c[of == g].mean(0) if (of == g).any() else middles[g] for g in range(groups)])
    return of


class Bounds:
    """A batch's vectors with their clusters and bounds. before: the centroids when the bounds were made (None: none are yet)."""

    def __init__(self, x: np.ndarray, cluster, upper, lower, centroids: np.ndarray, before: np.ndarray | None, group: np.ndarray):
        self.x, self.c, self.group, self.n_groups = x, centroids, group, int(group.max()) + 1
        #: how many distances were computed: what the bounds save shows here
        self.computed = 0
        if before is None:
            self._scan_all()
        else:
            self.cluster, self.upper, self.lower = cluster.copy(), upper.copy(), lower.copy()
            self._move(np.array([float(root(squared(b[None, :], a))[0]) for a, b in zip(before, centroids, strict=True)]))

    def distance(self, rows: np.ndarray, k: int) -> np.ndarray:
        self.computed += len(rows)
        return squared(self.x[rows], self.c[k])

    def _scan_all(self) -> None:
        rows = np.arange(len(self.x))
        d = np.array([self.distance(rows, k) for k in range(len(self.c))])
        self.cluster = np.argmin(d, axis=0)
        far = root(d)
        self.upper = far[self.cluster, rows]
        far[self.cluster, rows] = np.inf
        self.lower = np.stack([far[self.group == g].min(axis=0) if (self.group == g).any() else np.full(len(rows), np.inf) for g in range(self.n_groups)], axis=1)

    def _move(self, step: np.ndarray) -> None:
        step = step * (1 + SLACK)
        longest = np.array([step[self.group == g].max() if (self.group == g).any() else 0.0 for g in range(self.n_groups)])
        self.upper = (self.upper + step[self.cluster]) * (1 + SLACK)
        # an infinite bound (no other centroid in the group) stays infinite
        self.lower = np.maximum(self.lower * (1 - SLACK) - longest, 0.0)
        # the global filter, first with the bound, then with the exact distance
        rows = np.flatnonzero(~(self.upper * (1 + SLACK) < self.lower.min(axis=1)))
        exact = np.empty(len(rows), dtype=object if self.x.dtype == object else np.int64)
        for k in np.unique(self.cluster[rows]):
            at = np.flatnonzero(self.cluster[rows] == k)
            exact[at] = self.distance(rows[at], k)
        self.upper[rows] = root(exact)
        open_ = ~(self.upper[rows] * (1 + SLACK) < self.lower[rows].min(axis=1))
        rows, exact = rows[open_], exact[open_]
        self._scan_groups(rows, exact)

    def _scan_groups(self, rows: np.ndarray, own: np.ndarray) -> None:
        """The exact scan of the groups that the bounds don't exclude. own: the exact squared distances to the present centroids."""
        old, best, best_d = self.cluster[rows], self.cluster[rows].copy(), own.copy()
        bound = self.upper[rows].copy()
        scanned: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for g in range(self.n_groups):
            members = np.flatnonzero(self.group == g)
            at = np.flatnonzero(~(bound * (1 + SLACK) < self.lower[rows, g]))
            if not len(at) or not len(members):
                continue
            d = np.array([self.distance(rows[at], k) for k in members])
            scanned[g] = (at, members, d)
            for i, k in enumerate(members):
                nearer = (d[i] < best_d[at]) | ((d[i] == best_d[at]) & (k < best[at]))
                best[at[nearer]], best_d[at[nearer]] = k, d[i][nearer]
        self.cluster[rows], self.upper[rows] = best, root(best_d)
        # scanned groups get exact bounds without the vector's own centroid; an old centroid in a group passed over may now be its nearest
        for g, (at, members, d) in scanned.items():
            far = root(d)
            far[members[:, None] == best[at][None, :]] = np.inf
            self.lower[rows[at], g] = far.min(axis=0)
        left = np.flatnonzero(best != old)
        before = self.group[old[left]]
        self.lower[rows[left], before] = np.minimum(self.lower[rows[left], before], root(own[left]))

    def own(self) -> np.ndarray:
        """Exact squared distances to the clusters' centroids."""
        out = np.empty(len(self.x), dtype=object if self.x.dtype == object else np.int64)
        for k in np.unique(self.cluster):
            at = np.flatnonzero(self.cluster == k)
            out[at] = squared(self.x[at], self.c[k])
        return out


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> list[Decimal]:
    """k * dim sums, then k counts."""
    sums = [x[cluster == c].sum(axis=0) for c in range(k)]
    return [Decimal(int(s)) for row in sums for s in (row if np.ndim(row) else [0] * x.shape[1])] + [Decimal(int((cluster == c).sum())) for c in range(k)]


def assigned(state: DataFrame, centroids: list[list[int]], before: list[list[int]] | None, group: list[int], last: bool = False) -> DataFrame:
    """One pass: the vectors (id, v, cluster, upper, lower) with clusters and bounds for `centroids`, and a row a batch with the clusters'
    sums and counts (sums; null in the others). last: with each vector's squared distance, without bounds and sums."""
    import pyarrow as pa

    id_type, k, dim = state.schema["id"].dataType.simpleString(), len(centroids), len(centroids[0])
    now, then, of = np.array(centroids, dtype=object), None if before is None else np.array(before, dtype=object), np.array(group)
    money = pa.list_(pa.decimal128(38, 0))

    def plain(c):
        return c.astype(np.int64) if c is not None and np.abs(c).max() < PLAIN else c

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = batch.column("id"), batch.num_rows
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            if np.abs(x).max() >= PLAIN:
                x = x.astype(object)
            lower = None if then is None else batch.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            old = (None, None) if then is None else (batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("upper").to_numpy(zero_copy_only=False))
            b = Bounds(x, old[0], old[1], lower, plain(now), plain(then), of)
            if last:
                far = [min(int(d), LONG) for d in b.own()]
                yield pa.RecordBatch.from_pydict({"id": ids, "cluster": pa.array(b.cluster, pa.int32()), "distance": pa.array(far, pa.int64())})
                continue
            flat = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * a.shape[1], pa.int32()), pa.array(a.reshape(-1)))
            columns = {"id": ids, "v": batch.column("v"), "cluster": pa.array(b.cluster, pa.int32()), "upper": pa.array(b.upper), "lower": flat(b.lower), "sums": pa.nulls(n, money)}
            yield pa.RecordBatch.from_pydict(columns)
            empty = {c: pa.nulls(1, a.type) for c, a in columns.items() if c != "sums"}
            yield pa.RecordBatch.from_pydict(empty | {"sums": pa.array([_sums(x, b.cluster, k)], money)})

    if last:
        return state.mapInArrow(run, f"id {id_type}, cluster int, distance long")
    return state.mapInArrow(run, f"id {id_type}, v array<bigint>, cluster int, upper double, lower array<double>, sums array<decimal(38,0)>")


def moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The means, rounded down, of the clusters in a table that `assigned` made; empty clusters' centroids stay."""
    k, dim = len(centroids), len(centroids[0])
    rows = state.where("sums is not null").select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = {r.i: int(r.s) for r in rows}
    count = [total[k * dim + c] for c in range(k)]
    return [[total[c * dim + j] // count[c] for j in range(dim)] if count[c] else centroids[c] for c in range(k)]


def yinyang(vectors: DataFrame, centroids: list[list[int]], rounds: int, groups: int | None = None) -> tuple[DataFrame, list[list[int]]]:
    """id, cluster, distance (squared, to the final centroids) of vectors (id, v), and the centroids. groups: a tenth of the centroids, two at least, unless given."""
    group = grouped(np.array(centroids, dtype=object), groups or max(2, len(centroids) // 10)).tolist()
    state, before = vectors, None
    for _ in range(rounds):
        new = written(assigned(_vectors(state), centroids, before, group), "clusters")
        if state is not vectors:
            dropped(state)
        state, before, centroids = new, centroids, moved(new, centroids)
        if centroids == before:
            break  # nothing moves any more: further rounds repeat this one
    last = written(assigned(_vectors(state), centroids, before, group, last=True), "assigned")
    if state is not vectors:
        dropped(state)
    return last, centroids


def _vectors(state: DataFrame) -> DataFrame:
    """A table of `assigned` without the sums' rows."""
    return state.where("sums is null") if "sums" in state.columns else state


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE, groups: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    ints = whole(vectors, id_col, vector_col, dim, scale)
    start = first_centroids(ints, k, seed)
    if not start:
        return spark.createDataFrame([], schema)
    found, centroids = yinyang(ints, start, rounds, groups)
    named = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids)], "cluster int, components string").select("cluster", F.sha2("components", 256).alias("centroid_sha256"))
    saturated = lambda c: F.least(c, F.lit(LONG).cast("decimal(38,0)")).cast("long")
    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    # k rows at most on each of these sides
    total = by.agg(F.sum("s").cast("decimal(38,0)").alias("all"))
    of = by.crossJoin(F.broadcast(total)).select("cluster", saturated(F.col("s").cast("decimal(38,0)")).alias("cluster_inertia"), saturated(F.col("all")).alias("inertia"))
    return found.join(F.broadcast(of.join(named, "cluster")), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql(k: int, rounds: int, seed: int, dim: int, scale: int) -> str:
    """The plain rounds, every distance computed, one table a round."""
    d2 = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT x.r, x.v, arg_min(c.n, ({d2}::HUGEINT, c.n)) AS n, min({d2})::BIGINT AS d FROM x, c{r} c GROUP BY ALL)"
    down = "(s - ((s % k) + k) % k) // k"
    parts = [
        f"x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {scale})::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INT AS n, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM x ORDER BY h NULLS LAST, v LIMIT {k}))",
    ]
    for r in range(rounds):
        parts += [
            near(r),
            f"m{r} AS (SELECT n, list(m ORDER BY i) AS v FROM (SELECT n, i, {down} AS m FROM (SELECT n, i, sum(v[i])::HUGEINT AS s, count(*) AS k FROM a{r}, (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY ALL)) GROUP BY n)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.v::BIGINT[], c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (n))",
        ]
    parts.append(near(rounds))
    return f"WITH {', '.join(parts)} SELECT x.vec_id, a.n AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.n)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN x USING (r) JOIN c{rounds} c USING (n)"


OP11_SQL = _sql(K, ROUNDS, SEED, DIM, SCALE)
