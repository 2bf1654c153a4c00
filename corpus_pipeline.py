"""From raw documents to shuffled token ids: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of documents; columns
beyond the usual ones go through, whatever their names. Texts of any length are read whole. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, exact_dedup, mixing, ngram_jaccard, quality
from textloom.llm.storage import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go. Null and empty texts are scored by their structure, null ids as held out; repeated rows share their score, a score at the threshold stays. Without labels all scores are equal and nothing goes."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays. Null counts as empty, so one empty document stays; a null id stays only where its group has no other; rows that repeat id and text, kept ones too, all stay or go together."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the smallest id stays. Documents without words link with nothing and stay, as do rows without an id; rows that repeat the smallest id stay together."""
    return ngram_jaccard.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by their source's rate and shuffled. A null source belongs to "other"; a null or empty text counts no bytes but is drawn; rows that repeat an id are drawn alike."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids. A null or empty text has no ids; each repeated row has its own result; other columns are dropped."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("ngram_jaccard", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", encode)]

#: None: a trained classifier isn't SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
