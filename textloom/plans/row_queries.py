"""Queries of rows corrected column by column: the parts, damaged the way scanners do, with a dose each."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import graph as g
from textloom.operators import learn, rows, safety
from textloom.plans.correct_queries import NOISE_FROM, NOISE_TO, _vocab
from textloom.sources.storage import stored
from textloom.sources.tables import table

COLUMNS = ["Kind", "Name", "Medication"]
MEDICATION = "insulin"


def _clean(spark, sf_dir):
    """row, Kind, Name: what the parts' columns hold."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.lower("p_type").alias("Kind"), F.col("p_name").alias("Name"))


def _damaged(spark, sf_dir):
    """row, Kind, Name, Medication: look-alike digits, m as rn, a letter dropped or nothing, by the part's number."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    digits = lambda c: F.translate(F.lower(c), NOISE_FROM, NOISE_TO)
    dropped = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.substring(w, 1, 2), F.substring(w, F.lit(4), F.length(w)))), " ")
    name = F.when(k == 0, digits("p_name")).when(k == 1, F.replace(F.col("p_name"), F.lit("m"), F.lit("rn"))).when(k == 2, dropped).otherwise(F.col("p_name"))
    kind = F.when(F.col("p_partkey") % 3 == 0, digits("p_type")).when(F.col("p_partkey") % 3 == 1, F.replace(F.lower("p_type"), F.lit("m"), F.lit("rn"))).otherwise(F.col("p_type"))
    size = F.translate((F.col("p_size") * 11).cast("string"), "01", "Ol")
    dose = F.when(k == 3, F.concat(F.lit("insulin "), F.col("p_size").cast("string"), F.lit("units"))).otherwise(F.concat(F.lit("insu1in "), size, F.lit("5"), F.when(k == 0, "mg").when(k == 1, " units").otherwise("units")))
    return p.select(F.col("p_partkey").alias("row"), kind.alias("Kind"), name.alias("Name"), dose.alias("Medication"))


def _medications(words):
    """The words of seven letters and more stand for names that mustn't be mixed up."""
    return words.where(F.length("word") >= 7)


def _cells(spark, sf_dir):
    clean, damaged = _clean(spark, sf_dir), _damaged(spark, sf_dir)
    long = learn.cells(clean, COLUMNS[:2], "row").select("col", F.explode(F.split(F.lower("value"), " ")).alias("word"))
    expected = long.unionByName(spark.range(1).select(F.lit("Medication").alias("col"), F.lit(MEDICATION).alias("word")))
    vocab = stored(_vocab(spark, sf_dir).unionByName(expected.select("word")).distinct(), "vocab")
    both = clean.select(F.col("Name").alias("text")).unionByName(damaged.select(F.col("Name").alias("text")))
    lines = both.select(tx.model_tokens(F.col("text")).alias("ws")).where(F.size("ws") >= 2)
    cells = rows.correct_rows(
        damaged, "row", COLUMNS, vocab, expected.distinct(), long.where("col = 'Name'").groupBy("word").agg(F.count("*").alias("n")), learn.chains(clean, COLUMNS[:2]), g.batch_resonance(stored(g.next_words(lines), "next")), None, _medications(vocab), ocr=True
    )
    return cells, vocab


def row_corrections(spark, sf_dir):
    """Each cell as it was and as it became, with its words' flags and mean confidence."""
    cells, _ = _cells(spark, sf_dir)
    total = F.aggregate("words", F.lit(0.0), lambda s, w: s + w["confidence"])
    return cells.select("row", "col", "input", "output", F.array_join(F.transform("words", lambda w: w["flag"]), ",").alias("flags"), F.round(total / F.size("words") + 1e-9, 6).alias("confidence"))


def row_decisions(spark, sf_dir):
    """What is decided of each row, of its words and safety flags."""
    cells, vocab = _cells(spark, sf_dir)
    return rows.decisions(cells, stored(rows.cell_flags(cells, safety.ranges(spark), _medications(vocab)), "flags"))


QUERIES = {"row_corrections": row_corrections, "row_decisions": row_decisions}
SQL = {}
