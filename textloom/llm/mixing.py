"""Mixing sources to target weights by Poisson replication.

Each source class has a target share of the output's bytes. Its mean repetition rate is share * total bytes / its own bytes, so
one pass of counting fixes all rates. A document's count is drawn by inverting the Poisson distribution with that mean at a uniform
number hashed from seed and id: no state, no order, the same count wherever and whenever the task runs. The document is exploded by
its count, and the copies are shuffled globally: dealt to partitions by a hash of (seed, id, copy), and sorted by it there.

The classes are those that the caller lists, and one for all others, so the table of rates has a bound known beforehand and is
broadcast; a hot source is never a join or a window key. Rates above `block` are split into equal independent draws (a sum of Poisson
draws is Poisson), so the inversion stays within doubles at any rate.

Defined cases. A null source belongs to "other". Null and empty texts count no bytes but are drawn like any document; a class without
bytes has rate 1. A null id is hashed as the text "null". Rows that repeat an id get the same count. Weights are made to sum to 1; a
listed class without documents leaves its share unused. Columns of the input are kept, save those that the operator adds
(copy, n_copies, rate, shuffle_key), which replace columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.storage import column

OTHER = "other"
#: The production mixture: shares of bytes. The hot source is cut to a quarter, three are raised, all others keep the rest.
WEIGHTS = {"src0": 0.25, "src1": 0.08, "src2": 0.08, "src3": 0.08, OTHER: 0.51}
SEED, BLOCK = 20, 16.0
#: Copies made at a time of one document.
SPLIT = 10_000
#: The columns that `replicate` adds.
OWN = ("copy", "n_copies", "rate", "shuffle_key")


def uniform(seed: int, *parts: Column | str) -> Column:
    """52 bits hashed from seed and parts, as a number in [0, 1)."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def class_of(source: Column, weights: dict[str, float]) -> Column:
    listed = sorted(k for k in weights if k != OTHER)
    return F.when(source.isin(listed), source).otherwise(F.lit(OTHER)) if listed else F.lit(OTHER)


def rates(docs: DataFrame, weights: dict[str, float], block: float = BLOCK, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """class, rate, draws and cdf (of one draw): at most a row for each weight and one more."""
    total = sum(weights.values())
    share = F.create_map(*[F.lit(x) for k, w in sorted(weights.items()) for x in (k, w / total)])
    sizes = docs.groupBy(class_of(F.col(source_col), weights).alias("class")).agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("bytes"))
    everything = sizes.agg(F.sum("bytes").alias("all_bytes"))
    rated = sizes.crossJoin(F.broadcast(everything)).select(
        "class", F.when(F.col("bytes") > 0, F.coalesce(F.try_element_at(share, F.col("class")), F.lit(0.0)) * F.col("all_bytes") / F.col("bytes")).otherwise(F.lit(1.0)).alias("rate")
    )
    drawn = rated.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(block))).cast("int")).withColumn("mean", F.col("rate") / F.col("draws"))
    # P(X <= k) for k up to where the rest is below 2^-52
    upto = (F.ceil(F.col("mean") + 10 * F.sqrt("mean")) + 20).cast("int")
    first = F.exp(-F.col("mean"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), upto),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
        lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), (acc["c"] + acc["p"] * F.col("mean") / k).alias("c"), F.concat(acc["all"], F.array(acc["c"] + acc["p"] * F.col("mean") / k)).alias("all")),
        lambda acc: acc["all"],
    )
    return drawn.select("class", "rate", "draws", cdf.alias("cdf"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, block: float = BLOCK, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", own: tuple[str, ...] = OWN) -> DataFrame:
    """docs, each as often as drawn, with copy (from 1), n_copies, rate and shuffle_key, or as `own` names them, in global random order."""
    weights = weights or WEIGHTS
    # the caller's columns travel as one struct, so no name of theirs can clash with one of ours
    kept = [c for c in docs.columns if c.lower() not in own]
    docs = docs.select(F.struct(*[column(c) for c in kept]).alias("__row"), docs[id_col].alias("__id"), docs[source_col].alias("__source"), docs[text_col].alias("__text"))
    id_col, source_col, text_col = "__id", "__source", "__text"
    table = F.broadcast(rates(docs, weights, block, source_col, text_col).select(F.col("class").alias("__class"), F.col("rate").alias("__rate"), F.col("draws").alias("__draws"), F.col("cdf").alias("__cdf")))
    below = lambda j: F.size(F.filter("__cdf", lambda c: c <= uniform(seed, id_col, j)))
    count = F.when(F.col("__draws") == 1, F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))).otherwise(F.aggregate(F.sequence(F.lit(0), F.col("__draws") - 1), F.lit(0), lambda acc, j: acc + below(j)))
    drawn = (
        docs.select("__row", id_col, class_of(F.col(source_col), weights).alias("__class"), uniform(seed, id_col, F.lit(0)).alias("__u"))
        .join(table, "__class")
        .withColumn("__n", count)
        .where("__n > 0")
        .select("__row", id_col, "__n", "__rate", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / SPLIT).cast("int"))).alias("__block"))
        # a document repeated without end is exploded block by block, so that no array grows with its count
        .select("__row", id_col, "__n", "__rate", F.explode(F.sequence(F.col("__block") * SPLIT + 1, F.least(F.col("__n"), (F.col("__block") + 1) * SPLIT))).alias("__copy"))
    )
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"shuffle{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("__copy").cast("string"))), 1, 15), 16, 10).cast("long")
    added = (F.col("__copy"), F.col("__n"), F.col("__rate"), key)
    out = drawn.select(*[F.col("__row")[c].alias(c) for c in kept], *[c.alias(n) for c, n in zip(added, own, strict=True)])
    return out.repartition(own[3]).sortWithinPartitions(own[3], own[0])


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The replicated documents in global random order, with the columns of docs."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    return replicate(rows, weights).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return replicate(docs).select("doc_id", "source", "copy", "n_copies", F.round("rate", 9).alias("rate"), "shuffle_key", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


_listed = ", ".join(f"'{k}'" for k in sorted(WEIGHTS) if k != OTHER)
_weights = ", ".join(f"('{k}', {w / sum(WEIGHTS.values())!r}::DOUBLE)" for k, w in sorted(WEIGHTS.items()))
OP8_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) AS n_bytes, CASE WHEN source IN ({_listed}) THEN source ELSE '{OTHER}' END AS class,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':0'), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE AS u
  FROM documents),
w(class, share) AS (VALUES {_weights}),
s AS (SELECT class, sum(n_bytes)::BIGINT AS bytes FROM d GROUP BY class),
r AS (SELECT s.class, CASE WHEN bytes > 0 THEN coalesce(share, 0) * (SELECT sum(bytes)::BIGINT FROM s) / bytes ELSE 1.0 END AS rate FROM s LEFT JOIN w USING (class)),
c AS (
  SELECT class, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
  UNION ALL SELECT class, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 10 * sqrt(rate)) + 20),
n AS (SELECT d.doc_id, d.source, d.n_bytes, any_value(c.rate) AS rate, count(*) FILTER (c.cdf <= d.u) AS n_copies FROM d JOIN c USING (class) GROUP BY d.doc_id, d.source, d.n_bytes),
e AS (SELECT *, unnest(range(1, n_copies::BIGINT + 1)) AS copy FROM n)
SELECT doc_id, source, copy::INTEGER AS copy, n_copies::INTEGER AS n_copies, round(rate, 9) AS rate,
       ('0x' || substr(md5('shuffle{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key, n_bytes::BIGINT AS n_bytes
FROM e
"""
