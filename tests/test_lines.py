"""Whole lines, their safety flags and what corrections teach, against worked examples."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.operators import learn, lines, safety


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "text", "changed"),
    [("give 1O mg or 5Omg now", "give 10 mg or 50mg now", 2), ("Ol is no dose", "Ol is no dose", 0), ("take 5 mg", "take 5 mg", 0), ("", "", 0), ("l2 units", "12 units", 1)],
)
def test_numbers_of_a_line(spark, line, text, changed):
    assert value(spark, lines.normalized_numbers(F.col("line")), line=line) == (text, changed)


@pytest.mark.parametrize(("word", "fixed"), [("ICU", "ICU"), ("Ward", "Ward"), ("wArd", "ward"), ("DIABETES", "diabetes"), ("dose", "dose"), ("A", "A")])
def test_case_of_known_words(spark, word, fixed):
    assert value(spark, lines.exact_case(F.col("w")), w=word) == fixed


def test_noise_and_column_kinds(spark):
    assert [value(spark, lines.noise(F.col("t")), t=t) for t in ("", "|--|", "a", "|" * 20 + "ab", "é" + "-" * 5)] == [True, True, False, True, False]
    assert [value(spark, lines.column_kind(F.col("t")), t=t) for t in ("Wrd 3", "12 fever", "chronic case", "plain")] == ["ward_structure", "diagnosis", "ward_structure", None]
    cells = F.split("c", r"\|")
    assert [value(spark, lines.column_kind(F.lit("x"), cells), c=c) for c in ("a|bbb|c", "aa|bb", "|", "a|a|a|a|a|long")] == ["names", "ward_structure", "ward_structure", "diagnosis"]


def test_vocabulary_of_columns(spark):
    columns = spark.createDataFrame([("Patient Name",), ("Diagnosis",), ("Medication",), ("remarks",)], "column string")
    terms = spark.createDataFrame([("names", "Ali Baba"), ("diagnoses", "Heart Failure"), ("medications", "Insulin")], "category string, term string")
    found = {}
    for r in lines.vocabulary_words(columns, terms).collect():
        found.setdefault(r["column"], set()).add(r["word"])
    assert found["Patient Name"] == {"ali baba"} and found["Diagnosis"] == {"heart", "failure"} and found["Medication"] == {"insulin"}
    assert {"ali baba", "heart", "insulin"} <= found["remarks"]


def test_safety_flags_of_lines(spark):
    words = spark.createDataFrame([(i, p, w) for i, line in enumerate(["sodium was 300 then 140", "sodium a b c 300", "Insulin 5OOunits", "aspirin 6000mg", "aspirln now", "aspirin 6000ml"]) for p, w in enumerate(line.split())], "line_id long, pos int, word string")
    medications, ambiguous = spark.createDataFrame([("insulin",), ("Aspirin",)], "word string"), spark.createDataFrame([("aspirln",)], "query string")
    found = lines.safety_flags(words, safety.ranges(spark), medications, ambiguous).collect()
    assert {(r.line_id, r.pos, r.status, r.name) for r in found} == {(0, 2, "OUT_OF_RANGE", "sodium"), (2, 1, "IMPLAUSIBLE_DOSE", "insulin"), (3, 1, "IMPLAUSIBLE_DOSE", "aspirin"), (4, 0, "MEDICATION_AMBIGUITY", None)}
    assert lines.safety_flags(words.limit(0), safety.ranges(spark), medications).count() == 0


def test_words_of_any_length_teach_letters(spark):
    pairs = spark.createDataFrame([("rnedication", "medication"), ("d0se", "dose"), ("D0SE", "dose"), (None, "x"), ("", "x")], "ocr string, ok string")
    counts = learn.aligned_counts(pairs, "ocr", "ok", 3.0)
    found = {(r.kind, r.pair): r.n for r in counts.collect()}
    assert found["error", "m,n"] == 3 and found["error", "0,o"] == 6 and found["ok", "d"] == 9 and ("error", "r") not in found
    sure = {r.letter: r.confidence for r in learn.letter_confidence(counts).collect()}
    assert sure["0"] == 0 and sure["e"] == 1 and sure["n"] == pytest.approx(3 / 6)


def test_corrections_far_from_what_was_read_are_rejected(spark):
    rows = spark.createDataFrame([(1, "fever", "xylophone"), (2, "fever", "fevers"), (3, "fever", "headache"), (4, "same", "same"), (5, "", "xylophone"), (6, "a xylophone", "the xylophone")], "row int, ocr string, confirmed string")
    known = spark.createDataFrame([("headache",)], "word string")
    assert {(r.row, r.word) for r in learn.rejected_words(rows, known, ["row"], {}).collect()} == {(1, "xylophone")}


def test_the_other_profile_of_costs(spark):
    cost = lambda n, total: spark.range(1).select(learn.experience_cost(F.lit(0.5), F.lit(n), F.lit(total))).first()[0]
    assert cost(0, 50) == 0.5 and cost(5, 9) == 0.5
    assert cost(10, 50) == pytest.approx(0.25 + 0.5 * (0.5 * math.exp(-1) + 0.05)) and cost(10, 500) == pytest.approx(0.5 * math.exp(-1) + 0.05)
