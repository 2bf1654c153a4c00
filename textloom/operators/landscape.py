"""Classifiers over feature vectors: diagonal Gaussians by label, templates, votes, rejection, rules between confused labels.

A model is a row a label with array columns, so its size is labels x dimensions whatever the number of vectors. Its rows are counted
before it is broadcast; beyond LABELS of them Spark deals both sides over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
VAR_FIRST, VAR_FLOOR, VAR_EPS, GLOBAL_EPS, REJECT_Z = 2.0, 0.1, 1e-8, 1e-6, 5.0
#: The most labels of a model that is broadcast.
LABELS = 10_000


def fit(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, dim, n, mu, var: population variance, not below 0.1 / sqrt(n); of a single vector, 2."""
    long = vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    agg = long.groupBy("label", "dim").agg(F.count("x").alias("n"), F.avg("x").alias("mu"), F.var_pop("x").alias("v"))
    return agg.select("label", "dim", "n", "mu", F.when(F.col("n") == 1, F.lit(VAR_FIRST)).otherwise(F.greatest("v", VAR_FLOOR / F.sqrt("n"))).alias("var"))


def model(landscape: DataFrame) -> DataFrame:
    """label, n, mus, vars (the smaller of the label's variance and that of the labels' means)."""
    spread = landscape.withColumn("gvar", F.var_pop("mu").over(Window.partitionBy("dim")) + GLOBAL_EPS)
    s = spread.groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "mu", F.least("var", "gvar").alias("v"), "var"))).alias("d"))
    return s.select("label", "n", F.col("d.mu").alias("mus"), F.col("d.v").alias("vars"), F.col("d.var").alias("own_vars"))


def beside(m: DataFrame, labels: int = LABELS) -> DataFrame:
    """A model as the other side of a join with vectors: broadcast if it has `labels` rows at most."""
    return F.broadcast(m) if m.limit(labels + 1).count() <= labels else m


def _fold(x: Column, mus: Column, vars_: Column, term) -> Column:
    zipped = F.arrays_zip(x.alias("x"), mus.alias("m"), vars_.alias("v"))
    return F.transform(zipped, lambda t: term(t["x"].cast("double") - t["m"], t["v"]))


def scores(vectors: DataFrame, m: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, label, score for each label: -1/2 sum (x - mu)^2 / var + 1/2 ln(n + 1)."""
    pairs = vectors.select(key, F.col(vector).alias("x")).crossJoin(beside(m.select("label", "n", "mus", "vars")))
    total = F.aggregate(_fold(F.col("x"), F.col("mus"), F.col("vars"), lambda d, v: d * d / (v + VAR_EPS)), F.lit(0.0), lambda a, b: a + b)
    return pairs.select(key, "label", (-0.5 * total + 0.5 * F.log(F.col("n") + 1)).alias("score"))


def best(scored: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, predicted, score, margin to the second, span of all scores, confidence = clamp(margin / max(|span|, 0.01))."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "label")
    r = scored.withColumn("rank", F.row_number().over(w))
    g = r.groupBy(key).agg(F.min_by("label", "rank").alias("predicted"), F.max("score").alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.min("score").alias("least"))
    margin = F.col("score") - F.col("second")
    return g.select(key, "predicted", "score", margin.alias("margin"), F.least(F.greatest(margin / F.greatest(F.abs(F.col("score") - F.col("least")), F.lit(0.01)), F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def rejection(vectors: DataFrame, m: DataFrame, key: str = "vec_id", vector: str = "embedding", limit: float = REJECT_Z) -> DataFrame:
    """key, z (the least over labels of the largest |x - mu| / sd), rejected."""
    pairs = vectors.select(key, F.col(vector).alias("x")).crossJoin(beside(m.select("label", "mus", "own_vars")))
    worst = F.array_max(_fold(F.col("x"), F.col("mus"), F.col("own_vars"), lambda d, v: F.abs(d) / F.sqrt(v)))
    return pairs.select(key, worst.alias("z")).groupBy(key).agg(F.min("z").alias("z")).withColumn("rejected", F.col("z") > limit)


def templates(vectors: DataFrame, m: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, label, cosine with the label's mean vector."""
    from textloom.functions.distance import cosine

    pairs = vectors.select(key, F.col(vector).cast("array<double>").alias("x")).crossJoin(beside(m.select("label", "mus")))
    return pairs.select(key, "label", cosine(F.col("x"), F.col("mus")).alias("cosine"))


def nearest_mean(vectors: DataFrame, m: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, label, L1 distance to the label's mean vector."""
    pairs = vectors.select(key, F.col(vector).alias("x")).crossJoin(beside(m.select("label", "mus", "vars")))
    return pairs.select(key, "label", F.aggregate(_fold(F.col("x"), F.col("mus"), F.col("vars"), lambda d, v: F.abs(d)), F.lit(0.0), lambda a, b: a + b).alias("distance"))


def vote(votes: DataFrame, key: str = "vec_id") -> DataFrame:
    """From key, engine, label, confidence, weight: the label with the largest sum of weight * confidence, agreement, margin and confidence."""
    by = votes.groupBy(key, "label").agg(F.sum(F.col("weight") * F.col("confidence")).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(key)
    r = by.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("s", 9)), "label"))).withColumn("total", F.sum("s").over(w)).withColumn("engines", F.sum("n").over(w))
    g = r.groupBy(key).agg(F.min_by("label", "rank").alias("label"), F.max(F.when(F.col("rank") == 1, F.col("s"))).alias("s1"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("s"))), F.lit(0.0)).alias("s2"), F.max(F.when(F.col("rank") == 1, F.col("n") / F.col("engines"))).alias("agreement"), F.max("total").alias("total"))
    margin = (F.col("s1") - F.col("s2")) / F.greatest("total", F.lit(0.01))
    return g.select(key, "label", "agreement", margin.alias("margin"), (0.5 * F.col("agreement") + 0.5 * F.least(margin, F.lit(1.0))).alias("confidence"))


def diagnostic(landscape: DataFrame, k: int = 3) -> DataFrame:
    """a, b, dim, power, threshold, rank: the dimensions that tell two labels apart best, with the midpoint between their means."""
    left = landscape.select(F.col("label").alias("a"), "dim", F.col("mu").alias("ma"), F.col("var").alias("va"))
    right = landscape.select(F.col("label").alias("b"), "dim", F.col("mu").alias("mb"), F.col("var").alias("vb"))
    p = left.join(right, "dim").where("a < b").select("a", "b", "dim", (F.abs(F.col("ma") - F.col("mb")) / (F.col("va") + F.col("vb"))).alias("power"), ((F.col("ma") + F.col("mb")) / 2).alias("threshold"))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc(F.round("power", 9)), "dim"))).where(F.col("rank") <= k)
