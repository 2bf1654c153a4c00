import random

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.distance import CORE_COSTS, STATIC_COSTS, cosine, weighted_distance
from textloom.functions.lcs import lcs_length
from textloom.operators import correct, learn, safety


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("r")).first().r


def test_digraphs_and_forms(spark):
    assert one(spark, tx.fix_digraphs(F.col("w")), w="rnedication") == "medication"
    assert one(spark, tx.index_form(F.col("w")), w="A1-ph0") == "alpho"
    assert sorted(one(spark, tx.deletions(F.col("w")), w="abb")) == ["ab", "bb"]
    assert one(spark, tx.deletions(F.col("w")), w="") == []


def test_case(spark):
    case = lambda a, b: one(spark, tx.preserve_case(F.col("a"), F.col("b")), a=a, b=b)
    assert [case("STROK", "stroke"), case("Strok", "stroke"), case("strok", "Stroke"), case("sTrok", "stroke")] == ["STROKE", "Stroke", "stroke", "stroke"]


def test_digits_and_doses(spark):
    assert one(spark, tx.normalize_digits(F.col("w")), w="5OOl x") == "5001 x"
    assert one(spark, tx.normalize_digits(F.col("w")), w="Oral") == "Oral"
    d = one(spark, tx.dose(F.col("w")), w="5OOmg")
    assert (d.text, d.value, d.unit, d.changes) == ("500mg", 500.0, "mg", 2)
    assert one(spark, tx.dose(F.col("w")), w="stroke") is None


def brute(a, b, costs):
    a, b = a.lower(), b.lower()
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [i + 1.0]
        for j, y in enumerate(b):
            sub = 0.0 if x == y else costs.get(",".join(sorted((x, y))), 1.0)
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + sub))
        row = new
    return row[-1]


def test_weighted_distance(spark):
    r = random.Random(0)
    pairs = [("str0ke", "stroke"), ("", "ab"), ("ab", ""), ("", "")] + [tuple("".join(r.choice("olO01rnmec|") for _ in range(r.randrange(9))) for _ in "ab") for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for costs in (STATIC_COSTS, CORE_COSTS):
        got = df.select("a", "b", weighted_distance(F.col("a"), F.col("b"), costs).alias("d")).collect()
        assert all(abs(x.d - brute(x.a, x.b, costs)) < 1e-9 for x in got)
    assert one(spark, weighted_distance(F.col("a"), F.col("b")), a="str0ke", b="stroke") == 0.1
    assert one(spark, weighted_distance(F.col("a"), F.col("b"), CORE_COSTS), a="pat1ent", b="patient") == 0.2


def test_lcs_and_cosine(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c"], 2), ([], ["a"], 0), (["a"], [], 0), (["b", "a", "b"], ["a", "b", "b"], 2)], "x array<string>, y array<string>, n int")
    assert all(r.n == r.got for r in df.select("n", lcs_length(F.col("x"), F.col("y")).alias("got")).collect())
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in v.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.707107, 0.0]


def test_guards(spark):
    words = {"": "empty", "3,4/5": "number", "Dr.": "title", "5OOmg": "dosage", "3O2A": "room_code", "--a--": "punctuation", "stroke": None}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.f for r in df.select("w", correct.guard(F.col("w")).alias("f")).collect()} == words


VOCAB = ["stroke", "seizure", "levetiracetam", "medication", "patient", "infection", "chest", "potassium", "glucose"]


def test_words_and_lines(spark):
    vocab = spark.createDataFrame([(w,) for w in VOCAB], "word string")
    tokens = ["str0ke", "Levetiracelam", "rnedication", "stroke", "xyzzyplugh", "5OOmg", "for", "patlent"]
    words = correct.correct_words(spark.createDataFrame([(t,) for t in tokens], "query string"), vocab, spark.createDataFrame([("for",)], "word string"))
    got = {r.query: (r.corrected, r.flag) for r in words.collect()}
    assert got["str0ke"][0] == "stroke" and got["Levetiracelam"][0] == "Levetiracetam" and got["patlent"][0] == "patient"
    assert got["rnedication"] == ("medication", "digraph_corrected") and got["stroke"] == ("stroke", "exact")
    assert got["xyzzyplugh"] == ("xyzzyplugh", "unknown") and got["5OOmg"] == ("5OOmg", "dosage")
    lines = spark.createDataFrame([(1, "(str0ke) patlent."), (2, "xyzzyplugh")], "line_id int, text string")
    out = {r.line_id: (r.corrected, r.decision) for r in correct.correct_lines(lines, words).collect()}
    assert out[1][0] == "(stroke) patient." and out[2] == ("xyzzyplugh", "verify")


def test_ranges(spark):
    v = spark.createDataFrame([("potassium", "4.5"), ("potassium", "45"), ("Glucose", "6,5"), ("potassium", "9999"), ("what", "1"), ("ph", "x")], "name string, raw string")
    got = {(r.name, r.raw): (r.status, r.severity, r.alternatives) for r in safety.check_ranges(v, safety.ranges(spark)).collect()}
    assert got["potassium", "4.5"][0] == "in_range" and got["Glucose", "6,5"][0] == "in_range"
    assert got["potassium", "45"] == ("OUT_OF_RANGE", "warning", [4.5])
    assert got["potassium", "9999"][:2] == ("OUT_OF_RANGE", "error")
    assert got["what", "1"][0] == "unknown_lab" and got["ph", "x"][0] == "parse_error"


def test_learning(spark):
    cost = lambda b, n, t: round(one(spark, learn.adapted_cost(F.col("b"), F.col("n"), F.col("t")), b=b, n=n, t=t), 6)
    assert cost(0.1, 20, 40) == 0.06 and cost(0.2, 20, 40) == 0.08 and cost(0.3, 0, 40) == 0.3 and cost(0.3, 2, 4) == 0.3
    rows = spark.createDataFrame([("Abdullah", "chest infection")], "Patient string, Diagnosis string")
    c = learn.chains(rows, ["Patient", "Diagnosis"]).where("ctx_col = 'Patient'").collect()
    assert {(r.ctx_val, r.token, r.n) for r in c} == {("abdullah", "chest infection", 1), ("abdullah", "chest", 1), ("abdullah", "infection", 1)}
    w = spark.createDataFrame([("Medication",), ("Diagnosis",), ("Room",), ("notes",)], "c string").select("c", learn.column_weight(F.col("c")).alias("w")).collect()
    assert [r.w for r in w] == [3.0, 2.5, 1.0, 1.0]


def test_lcs_accuracy_takes_whole_turns(spark, tmp_path):
    from textloom.plans.correct_queries import lcs_accuracy

    spark.createDataFrame([(1, 0, "bb"), (1, 1, "aa " * (1 << 20) + "bb")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in lcs_accuracy(spark, str(tmp_path)).collect()] == [(1, 1, (1 << 20) + 1, 1, 1)]


def test_a_dose_is_put_right_once(spark):
    """The plan holds the digits' repair once, not wherever its result is named."""
    df = spark.createDataFrame([("5Omg",), (None,), ("mg",), ("l5,5ML",), ("x5mg",)], "t string").select(tx.dose(F.col("t")).alias("d"))
    assert df._jdf.queryExecution().analyzed().toString().count("translate(") == 1
    assert [r.d and tuple(r.d) for r in df.collect()] == [("50mg", 50.0, "mg", 1), None, None, ("15,5ml", 15.5, "ml", 1), None]
