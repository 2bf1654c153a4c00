"""Exact deduplication: group by a 128-bit content hash, compare the bytes inside a group, keep the smallest id.

Plan. (1) The texts are grouped by (hash, text): Spark's hash aggregation compares the bytes of the texts that share a hash, and
its map-side half folds the copies of a hot text into one row a task before anything is shuffled. This is the only shuffle of
texts, and each distinct text crosses it about once. (2) What remains is narrow: each document's digests are joined with the
groups. A hot group's documents lie on the streamed side of an equi-join, which adaptive execution splits; nothing is gathered.

Should two texts share the 128-bit hash, the grouping keeps them apart, and the narrow join tells them apart by SHA-256 as well.
Should two texts share both, which no one has seen, the query stops with an error rather than returning a wrong group.

Defined cases. Null text counts as empty, and empty texts are equal. A null id never stays while its group has an id. Rows that
repeat both id and text are one document stored several times: each comes back, with the same values. An empty table gives an
empty result. Extra columns pass through `mark` untouched, whatever their names: the operator's own columns replace only columns
of the same name (keep_id, group_size, kept, text_sha256).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.storage import column

#: A run of white space that isn't one plain space already; such a run becomes one space.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """text with every run of [\\x20\\x09-\\x0D] replaced by one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(text: Column) -> Column:
    """128 bits, as 16 bytes."""
    return F.unhex(F.md5(text))


#: The columns that `mark` adds.
OWN = ("keep_id", "group_size", "kept", "text_sha256")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = content_hash, own: tuple[str, ...] = OWN) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256, or as `own` names them. hashed: the content hash, another one in tests of collisions."""
    # the caller's columns travel as one struct, so no name of theirs can clash with one of ours
    kept = [c for c in docs.columns if c.lower() not in own]
    docs, text = docs.select(F.struct(*[column(c) for c in kept]).alias("__row"), docs[id_col].alias("__id"), docs[text_col].alias("__raw")), normalised(F.col("__raw"))
    texts = docs.select(hashed(text).alias("__key"), text.alias("__text"), "__id").groupBy("__key", "__text").agg(F.min("__id").alias("__keep"), F.count("*").alias("__size"))
    groups = (
        texts.select("__key", F.unhex(F.sha2("__text", 256)).alias("__sha"), "__keep", "__size")
        .groupBy("__key", "__sha")
        .agg(F.min("__keep").alias("__keep"), F.sum("__size").alias("__size"), F.count("*").alias("__texts"))
        .select("__key", "__sha", "__keep", F.when(F.col("__texts") == 1, F.col("__size")).otherwise(F.raise_error(F.lit("two texts share both digests")).cast("long")).alias("__size"))
    )
    # joined on both digests in one column: the groups are then dealt anew like the documents, and as no aggregation stands between
    # the shuffle and the join, adaptive execution can split a hot group's documents
    groups = groups.select(F.concat("__key", "__sha").alias("__both"), "__keep", "__size")
    keyed = docs.select("__row", "__id", F.concat(hashed(text), F.unhex(F.sha2(text, 256))).alias("__both"))
    added = (F.col("__keep"), F.col("__size"), F.col("__id").eqNullSafe(F.col("__keep")), F.lower(F.hex(F.substring("__both", -32, 32))))
    return keyed.join(groups, "__both").select(*[F.col("__row")[c].alias(c) for c in kept], *[c.alias(n) for c, n in zip(added, own, strict=True)])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the columns of docs."""
    return mark(docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text")), "id", "text").where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mark(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""
