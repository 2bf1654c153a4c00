"""Queries of the vector classifiers over `embeddings`, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import landscape as ls
from textloom.operators import learn
from textloom.sources.tables import table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def landscape_fit(spark, sf_dir):
    f = ls.fit(_vectors(spark, sf_dir))
    return f.select("label", "dim", "n", F.round("mu", 6).alias("mu"), F.round("var", 6).alias("var"))


def _scores(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return ls.scores(v, ls.model(ls.fit(v)))


def landscape_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("vec_id", "label", F.round("score", 6).alias("score"))


def landscape_predict(spark, sf_dir):
    b = ls.best(_scores(spark, sf_dir))
    return b.select("vec_id", "predicted", F.round("margin", 6).alias("margin"), F.round("confidence", 6).alias("confidence"))


def rejection_zscore(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return ls.rejection(v, ls.model(ls.fit(v))).select("vec_id", F.round("z", 6).alias("z"), "rejected")


def confusion_matrix(spark, sf_dir):
    b = ls.best(_scores(spark, sf_dir)).join(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id")
    return b.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def diagnostic_features(spark, sf_dir):
    d = ls.diagnostic(ls.fit(_vectors(spark, sf_dir)))
    return d.select("a", "b", "dim", F.round("power", 6).alias("power"), F.round("threshold", 6).alias("threshold"), "rank")


def template_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return ls.templates(v, ls.model(ls.fit(v))).select("vec_id", "label", F.round("cosine", 6).alias("cosine"))


def _votes(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    m = ls.model(ls.fit(v))

    def first(scored, order, engine, weight):
        r = scored.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(order, "label"))).where("rank = 1")
        return r.select("vec_id", F.lit(engine).alias("engine"), "label", F.lit(1.0).alias("confidence"), F.lit(weight).alias("weight"))

    return first(ls.scores(v, m), F.desc(F.round("score", 9)), "landscape", 1.0).unionByName(first(ls.templates(v, m), F.desc(F.round("cosine", 9)), "template", 0.8)).unionByName(first(ls.nearest_mean(v, m), F.round("distance", 9), "nearest", 0.6))


def ensemble_vote(spark, sf_dir):
    e = ls.vote(_votes(spark, sf_dir))
    return e.select("vec_id", "label", F.round("agreement", 6).alias("agreement"), F.round("margin", 6).alias("margin"), F.round("confidence", 6).alias("confidence"))


def ensemble_weight_ema(spark, sf_dir):
    """An engine's weight after each block of a hundred vectors, in order: a block's outcomes are a bounded array."""
    o = _votes(spark, sf_dir).join(_vectors(spark, sf_dir).select("vec_id", F.col("label").alias("truth")), "vec_id")
    s = o.groupBy("engine", F.floor(F.col("vec_id") / 100).alias("block")).agg(F.array_sort(F.collect_list(F.struct("vec_id", (F.col("label") == F.col("truth")).cast("int").alias("right")))).alias("o"))
    return s.select("engine", "block", F.round(learn.ema_weight(F.col("o.right")), 6).alias("weight"))


FIT = """l AS (SELECT vec_id, label, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
f AS (SELECT label, dim, count(x) AS n, avg(x) AS mu, CASE WHEN count(x) = 1 THEN 2 ELSE greatest(var_pop(x), 0.1::DOUBLE / sqrt(count(x))) END AS var FROM l GROUP BY ALL),
g AS (SELECT *, least(var, var_pop(mu) OVER (PARTITION BY dim) + 1e-6) AS v FROM f)"""
SC = """s AS (SELECT vec_id, g.label, -0.5::DOUBLE * sum((x - mu) * (x - mu) / (v + 1e-8)) + 0.5::DOUBLE * ln(any_value(n) + 1) AS score FROM l JOIN g USING (dim) GROUP BY vec_id, g.label)"""
BEST = """r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS rank FROM s),
b AS (SELECT vec_id, arg_min(label, rank) AS predicted, max(score) AS score, max(score) FILTER (rank = 2) AS second, min(score) AS least FROM r GROUP BY vec_id)"""
COS = "t AS (SELECT vec_id, g.label, sum(x * mu) / (sqrt(sum(x * x)) * sqrt(sum(mu * mu))) AS cosine, sum(abs(x - mu)) AS distance FROM l JOIN g USING (dim) GROUP BY vec_id, g.label)"
VOTES = """vt AS (SELECT vec_id, 'landscape' AS engine, label, 1.0::DOUBLE AS weight FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) = 1
UNION ALL SELECT vec_id, 'template', label, 0.8::DOUBLE FROM t QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(cosine, 9) DESC, label) = 1
UNION ALL SELECT vec_id, 'nearest', label, 0.6::DOUBLE FROM t QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 9), label) = 1)"""
SQL = {
    "landscape_fit": f"WITH {FIT} SELECT label, dim, n, round(mu, 6) AS mu, round(var, 6) AS var FROM f",
    "landscape_scores": f"WITH {FIT}, {SC} SELECT vec_id, label, round(score, 6) AS score FROM s",
    "landscape_predict": f"WITH {FIT}, {SC}, {BEST} SELECT vec_id, predicted, round(score - second, 6) AS margin, round(least(greatest((score - second) / greatest(abs(score - least), 0.01::DOUBLE), 0), 1), 6) AS confidence FROM b",
    "rejection_zscore": f"WITH {FIT}, z AS (SELECT vec_id, g.label, max(abs(x - mu) / sqrt(var)) AS z FROM l JOIN g USING (dim) GROUP BY vec_id, g.label) SELECT vec_id, round(min(z), 6) AS z, min(z) > 5 AS rejected FROM z GROUP BY vec_id",
    "confusion_matrix": f"WITH {FIT}, {SC}, {BEST} SELECT e.label, predicted, count(*) AS n FROM b JOIN embeddings e USING (vec_id) GROUP BY ALL",
    "diagnostic_features": f"WITH {FIT}, p AS (SELECT x.label AS a, y.label AS b, x.dim, abs(x.mu - y.mu) / (x.var + y.var) AS power, (x.mu + y.mu) / 2 AS threshold FROM f x JOIN f y ON x.dim = y.dim AND x.label < y.label) SELECT a, b, dim, round(power, 6) AS power, round(threshold, 6) AS threshold, row_number() OVER (PARTITION BY a, b ORDER BY round(power, 9) DESC, dim)::INT AS rank FROM p QUALIFY rank <= 3",
    "template_cosine": f"WITH {FIT}, {COS} SELECT vec_id, label, round(cosine, 6) AS cosine FROM t",
    "ensemble_vote": f"""WITH {FIT}, {SC}, {COS}, {VOTES}, a AS (SELECT vec_id, label, sum(weight) AS s, count(*) AS n FROM vt GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) AS rank, sum(s) OVER w AS total, sum(n) OVER w AS engines FROM a WINDOW w AS (PARTITION BY vec_id)),
      q AS (SELECT vec_id, arg_min(label, rank) AS label, max(s) FILTER (rank = 1) AS s1, coalesce(max(s) FILTER (rank = 2), 0) AS s2, max(n / engines) FILTER (rank = 1) AS agreement, max(total) AS total FROM r GROUP BY vec_id)
      SELECT vec_id, label, round(agreement, 6) AS agreement, round((s1 - s2) / greatest(total, 0.01), 6) AS margin, round(0.5 * agreement + 0.5 * least((s1 - s2) / greatest(total, 0.01), 1), 6) AS confidence FROM q""",
    "ensemble_weight_ema": f"""WITH {FIT}, {SC}, {COS}, {VOTES}, o AS (SELECT engine, vt.vec_id // 100 AS block, list((vt.label = e.label)::INT ORDER BY vt.vec_id) AS o FROM vt JOIN embeddings e USING (vec_id) GROUP BY ALL)
      SELECT engine, block, round(list_reduce(list_prepend([0::DOUBLE, 0::DOUBLE, 1::DOUBLE], list_transform(o, lambda x: [x::DOUBLE])), lambda a, x: [a[1] + 1, a[2] + x[1], CASE WHEN a[1] + 1 >= 5 THEN 0.9::DOUBLE * a[3] + 0.1::DOUBLE * least(greatest((a[2] + x[1]) / (a[1] + 1) / 0.5::DOUBLE, 0.1::DOUBLE), 3) ELSE a[3] END])[3], 6) AS weight FROM o""",
}
QUERIES = {n: globals()[n] for n in SQL}
