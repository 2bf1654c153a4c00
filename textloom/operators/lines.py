"""Whole lines: their numbers, what kind of column they belong to, which are noise, and the safety flags of their words.

Everything but the flags is a column expression over one line, so nothing is shuffled. The flags look back a few words, in one window
a line; names meet the flagged words by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import safety

#: Fixed values.
NUMBER_TOKEN, UNIT_TOKEN = r"^[0-9OoIl.,]+$", r"(?i)^(mg|mcg|g|ml|units?|iu|mmol|meq|µg)$"
DOSE_TOKEN = r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*(mg|g|mcg|ml|units?|iu)?$"
COLUMN_KINDS = ["ward_structure", "names", "diagnosis", "names", "ward_structure"]
VOCABULARY_OF = (
    (("patient", "name"), "names"), (("diagnos", "dx"), "diagnoses"), (("doctor", "assign"), "names"), (("status", "evacuation", "triage"), "ward_structure"), (("room", "ward", "bed"), "ward_structure"),
    (("med", "drug", "rx"), "medications"), (("lab", "result"), "labs"), (("exam", "finding"), "examination"),
)
NOISE_SHARE, SHORT_CAPITALS = 0.15, 5


def normalized_numbers(line: Column) -> Column:
    """struct(text, changed): a line's words, doses and numbers before a unit with digits for look-alike letters; how many words changed."""
    words = F.split(line, r"\s+")

    def fixed(word: Column, i: Column) -> Column:
        whole = tx.dose(word)
        before_unit = word.rlike(NUMBER_TOKEN) & F.coalesce(F.get(words, i + 1), F.lit("")).rlike(UNIT_TOKEN)
        return F.when(whole["changes"] > 0, whole["text"]).when(before_unit, tx.normalize_digits(word)).otherwise(word)

    out = F.transform(words, fixed)
    return F.struct(F.array_join(out, " ").alias("text"), F.aggregate(F.zip_with(words, out, lambda a, b: (a != b).cast("int")), F.lit(0), lambda n, x: n + x).alias("changed"))


def column_kind(line: Column, cells: Column | None = None) -> Column:
    """The kind of the longest cell's column (the first, if several are as long), where a table gives cells; else what the line's beginning tells; null if nothing does."""
    text = F.trim(line)
    by_text = (
        F.when(text.rlike(r"(?i)^w[a-z]*d?\s*[0-9]") | F.lower(line).contains("ward"), "ward_structure")
        .when(text.rlike("^[0-9]"), "diagnosis")
        .when(F.lower(line).rlike("icu|er|unassign|chronic"), "ward_structure")
    )
    if cells is None:
        return by_text
    sizes = F.transform(cells, F.length)
    at = F.when(F.array_max(sizes) > 0, F.array_position(sizes, F.array_max(sizes))).otherwise(F.lit(1))
    return F.when(cells.isNull(), by_text).otherwise(F.coalesce(F.get(F.array(*map(F.lit, COLUMN_KINDS)), (at - 1).cast("int")), F.lit("diagnosis")))


def column_vocabulary(column: Column) -> Column:
    """The category of terms that a column of this name takes; null: all."""
    out, name = None, F.lower(column)
    for parts, category in VOCABULARY_OF:
        fits = name.rlike("|".join(parts))
        out = F.when(fits, category) if out is None else out.when(fits, category)
    return out


def vocabulary_words(columns: DataFrame, terms: DataFrame) -> DataFrame:
    """column, word: the lower-case words that a column takes; terms of several words are split for diagnoses only. columns: column; terms: category, term."""
    t = terms.select("category", F.lower("term").alias("term"))
    split = F.filter(F.split("term", r"\s+"), lambda w: F.length(w) > 1)
    words = t.select("category", F.explode(F.when(F.col("category") == "diagnoses", split).otherwise(F.array("term"))).alias("word"))
    every = t.select(F.lit("").alias("category"), F.explode(F.array_union(F.array("term"), split)).alias("word"))
    wanted = columns.select("column").distinct().withColumn("category", F.coalesce(column_vocabulary(F.col("column")), F.lit("")))
    return wanted.join(words.unionByName(every).distinct(), "category").select("column", "word").distinct()


def exact_case(word: Column) -> Column:
    """Of a word that the vocabulary knows: short capitals and capitalised words stay, others become lower case."""
    capitals = (word == F.upper(word)) & (F.length(word) <= SHORT_CAPITALS)
    title = (F.substring(word, 1, 1) == F.upper(F.substring(word, 1, 1))) & (F.substring(word, F.lit(2), F.length(word)) == F.lower(F.substring(word, F.lit(2), F.length(word))))
    return F.when(capitals | title, word).otherwise(F.lower(word))


def noise(line: Column) -> Column:
    """Whether fewer than 15 % of a line's characters, or none, are letters or digits; empty lines are noise."""
    t = F.trim(line)
    return F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")) < F.greatest(F.length(t) * NOISE_SHARE, F.lit(1.0))


def repaired_dose(word: Column) -> Column:
    """struct(value, unit) of a dose in which O stands for 0, and l and I behind a digit for 1; null if it is none."""
    w = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "O", "0"), "(?<=[0-9])l", "1"), "(?<=[0-9])I", "1")
    value = F.regexp_extract(w, DOSE_TOKEN, 1).try_cast("double")
    return F.when(w.rlike(DOSE_TOKEN), F.struct(value.alias("value"), F.lower(F.regexp_extract(w, DOSE_TOKEN, 2)).alias("unit")))


def implausible(name: Column, word: Column) -> Column:
    """Whether a dose that follows a medication's name is too high."""
    d = repaired_dose(word)
    return F.coalesce(((d["unit"] == "mg") & (d["value"] > safety.MOST_MG)) | (F.lower(name).contains("insulin") & (d["value"] > safety.MOST_INSULIN)), F.lit(False))


def safety_flags(words: DataFrame, ranges: DataFrame, medications: DataFrame, ambiguous: DataFrame | None = None, line: str = "line_id", reach: int = safety.LOOK_BACK) -> DataFrame:
    """line, pos, status, severity, name, word: numbers out of the range of the nearest laboratory value up to `reach` words before, doses too high for
    the medication just before, words whose two best candidates are both medications. words: line, pos, word; ranges: see safety.ranges
    (a parameter's rows, so it is broadcast); medications: word; ambiguous: query, as safety.ambiguous_names gives them."""
    w = Window.partitionBy(line).orderBy("pos")
    plain = F.lower(F.regexp_replace("word", r"\s+", ""))
    named = words.withColumn("plain", plain).join(F.broadcast(ranges.select(F.col("name").alias("plain"), F.lit(True).alias("lab"))), "plain", "left")
    t = named.withColumn("before", F.last(F.when(F.col("lab"), F.col("plain")), ignorenulls=True).over(w.rowsBetween(-reach, -1))).withColumn("last", F.lower(F.lag("word").over(w)))
    numbers = t.where(F.col("word").rlike(r"^[0-9.,]+$") & F.col("before").isNotNull()).select(line, "pos", "word", F.col("before").alias("name"), F.col("word").alias("raw"))
    columns = [line, "pos", "status", "severity", "name", "word"]
    out = safety.check_ranges(numbers, ranges).where("status = 'OUT_OF_RANGE'").select(columns)
    doses = t.where(F.col("word").rlike("[0-9O]") & implausible(F.col("last"), F.col("word"))).join(medications.select(F.lower("word").alias("last")).distinct(), "last", "left_semi")
    out = out.unionByName(doses.select(line, "pos", F.lit("IMPLAUSIBLE_DOSE").alias("status"), F.lit("warning").alias("severity"), F.col("last").alias("name"), "word"))
    if ambiguous is not None:
        both = words.join(ambiguous.select(F.col("query").alias("q")).distinct(), F.lower("word") == F.col("q"), "left_semi")
        out = out.unionByName(both.select(line, "pos", F.lit("MEDICATION_AMBIGUITY").alias("status"), F.lit("danger").alias("severity"), F.lit(None).cast("string").alias("name"), "word"))
    return out
