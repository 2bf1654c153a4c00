r"""License scans by diagonal voting.

Every rolling word k-gram of every text is joined with the positions that it has in the license templates. A match votes for a
diagonal (place in the text less place in the template). The votes are counted by document, template and diagonal; diagonals that
lie within `slack` of each other, as words put in or left out cause, are merged; and a span holds if it covers enough of the
template's k-grams. The join compares the k-grams' words behind the hash, so votes are verified ones. A base phrase stands at a place
if its diagonal has a vote of each of its k-grams: then all its words are there, one after the other.

Plan. The templates are a parameter, so their few hundred k-grams are broadcast. The texts never cross a shuffle: only a document's
header row and its matches do, once, by row. All later steps (diagonals, merging, the document's row) reuse that partitioning.

Defined cases. Null and empty texts have no words: n_words 0, no labels, score 0. Repeated rows, or rows that share an id, each get
their own result. The input's other columns are dropped, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that are counted wherever they stand, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Longer templates for the fuzzy spans: words of public license texts and of the notices that refer to them.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("waived all copyright and related or neighboring rights", "cc0-1.0"),
    ("free and unencumbered software released into public domain", "unlicense"),
)
K, SLACK, COVERED = 2, 2, 0.7


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are: Spark's lower where the text is ASCII, as it is faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def gram_positions(spark: SparkSession, phrases: list[tuple[str, str, bool]], k: int) -> DataFrame:
    """template, label, base, grams (the template's number of them), gram, tpos: a row for each k-gram of each template."""
    rows = []
    for n, (phrase, label, base) in enumerate(phrases):
        words = phrase.split(" ")
        if len(words) < k:
            raise ValueError(f"{phrase!r} has fewer than {k} words")
        rows += [(n, label, base, len(words) - k + 1, " ".join(words[i : i + k]), i) for i in range(len(words) - k + 1)]
    names = ("template", "label", "base", "grams", "gram", "tpos")
    return spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(r, names, strict=True)]) for r in rows])).alias("x")).select("x.*")


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, k: int = K, slack: int = SLACK, covered: float = COVERED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first word, last word, coverage)."""
    spark = docs.sparkSession
    phrases = [(p, label, True) for p, label in base] + [(p, label, False) for p, label in templates]
    positions = gram_positions(spark, phrases, k).select("template", "label", "base", "grams", "tpos", F.col("gram").alias("tgram"), F.xxhash64("gram").alias("th"))
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.regexp_extract_all(lowered(F.col(text_col)), F.lit(WORD), F.lit(0)).alias("w"))
    rolling = F.transform("w", lambda x, i: F.concat_ws(" ", x, *[F.get("w", i + j) for j in range(1, k)]))
    # place 0 is the document's header row
    grams = words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), rolling)).alias("place", "gram"))
    votes = (
        grams.withColumn("h", F.xxhash64("gram"))
        .join(F.broadcast(positions), (F.col("h") == F.col("th")) & (F.col("gram") == F.col("tgram")), "left")
        .where("place = 0 or template is not null")
        .select("row", "doc_id", "n_words", "template", "label", "base", "grams", "tpos", (F.col("place") - 1 - F.col("tpos")).alias("diagonal"))
        .repartition("row")
    )
    header = ("row", "doc_id", "n_words")
    diagonals = votes.groupBy(*header, "template", "label", "base", "grams", "diagonal").agg(F.collect_set("tpos").alias("tposes"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    islands = diagonals.withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > slack, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(along))
    places = (F.col("base") & (F.size("tposes") == F.col("grams"))).cast("long")
    spans = (
        islands.withColumn("place", F.when(places == 1, F.col("diagonal").cast("long")))
        .groupBy(*header, "template", "label", "base", "grams", "island")
        .agg(
            F.count("place").alias("places"), F.min("place").alias("first"), F.max("place").alias("last"),
            (F.size(F.array_distinct(F.flatten(F.collect_list("tposes")))) / F.col("grams")).alias("coverage"),
            F.min(F.col("diagonal") + F.array_min("tposes")).cast("long").alias("from"), F.max(F.col("diagonal") + F.array_max("tposes") + (k - 1)).cast("long").alias("to"),
        )
    )
    holds = ~F.col("base") & (F.col("coverage") >= covered)
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return spans.groupBy(*header).agg(
        F.sum("places").alias("n_base"),
        F.min("first").alias("first_word"),
        F.max("last").alias("last_word"),
        joined(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
        joined(F.when((F.col("places") > 0) | holds, F.col("label"))).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when((F.col("places") > 0) | holds, F.struct("from", "to", "label", "coverage")))).alias("spans"),
    ).drop("row")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 9).alias("score"))


_values = ", ".join(f"({n}, '{label}', {b}, '{p}')" for n, (p, label, b) in enumerate([(p, x, "true") for p, x in BASE] + [(p, x, "false") for p, x in TEMPLATES]))
OP3_SQL = rf"""
WITH t(template, label, base, phrase) AS (VALUES {_values}),
tw AS (SELECT *, string_split(phrase, ' ') AS ws FROM t),
tg AS (SELECT template, label, base, len(ws) - 1 AS grams, unnest(range(len(ws) - 1)) AS tpos, ws FROM tw),
p AS (SELECT template, label, base, grams, tpos, ws[tpos + 1] || ' ' || ws[tpos + 2] AS gram FROM tg),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, unnest(list_zip(range(len(w)), w, w[2:])) AS z FROM d),
v AS (SELECT x.doc_id, template, label, base, grams, tpos, z[1] - tpos AS diagonal FROM x JOIN p ON p.gram = z[2] || ' ' || z[3]),
g AS (SELECT doc_id, template, label, base, grams, diagonal, list(tpos) AS tposes FROM v GROUP BY ALL),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island, CASE WHEN base AND len(tposes) = grams THEN diagonal END AS place FROM n),
s AS (SELECT doc_id, template, label, base, island, count(place) AS places, min(place) AS first_word, max(place) AS last_word, len(list_distinct(flatten(list(tposes)))) / any_value(grams)::DOUBLE AS coverage FROM i GROUP BY doc_id, template, label, base, island),
a AS (SELECT doc_id, sum(places)::BIGINT AS n_base, min(first_word)::BIGINT AS first_word, max(last_word)::BIGINT AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0 OR (NOT base AND coverage >= {COVERED})) AS labels, max(coverage) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 9) AS score
FROM d LEFT JOIN a USING (doc_id)
"""
