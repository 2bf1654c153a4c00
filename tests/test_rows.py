import pytest
from pyspark.sql import functions as F

from tests.rows_brute import Corrector
from textloom.functions.distance import STATIC_COSTS
from textloom.operators import learn, rows, safety

VOCAB = "abdullah bader chest infection stroke seizure levetiracetam potassium insulin patient with medication pain cheat cheap bored carbamazepine carbimazole small ring red bolt old anvil".split()
MEDS = ["levetiracetam", "insulin", "carbamazepine", "carbimazole"]


def words(spark, ws):
    return spark.createDataFrame([(w,) for w in ws], "word string")


def by_row(cells):
    return {(r.row, r.col): r for r in cells.collect()}


def test_goldens(spark):
    t = spark.createDataFrame([(1, "Abdulah", "chst infecfion", "Bader"), (2, None, "levetiracelam seizure", " "), (3, "", "str0ke", "insulin 3OO units 5OOmg")], "id long, Patient string, `Diag.x` string, Doctor string")
    cells = rows.correct_rows(t, "id", ["Patient", "Diag.x", "Doctor"], words(spark, VOCAB), medications=words(spark, MEDS))
    got = by_row(cells)
    assert got[1, "Patient"].output == "Abdullah" and got[1, "Doctor"].output == "Bader"
    assert got[1, "Diag.x"].output.startswith("chest")
    assert got[2, "Diag.x"].output == "levetiracetam seizure" and got[2, "Patient"].output is None and got[2, "Doctor"].output == " " and got[2, "Doctor"].words == []
    assert got[3, "Diag.x"].output == "stroke" and got[3, "Doctor"].output == "insulin 300 units 500mg"
    assert [w.flag for w in got[3, "Doctor"].words][-1] == "dose_normalized"


def test_flags_and_decisions(spark):
    t = spark.createDataFrame([(1, "potassium 9999"), (2, "stroke"), (3, "insulin 3OOunits"), (4, "carbimzepole"), (5, None)], "id long, line string")
    meds = words(spark, MEDS)
    cells = rows.correct_rows(t, "id", ["line"], words(spark, VOCAB), medications=meds, ocr=True)
    flags = rows.cell_flags(cells, safety.ranges(spark), meds)
    found = {(r.row, r.status) for r in flags.collect()}
    assert {(1, "OUT_OF_RANGE"), (3, "IMPLAUSIBLE_DOSE"), (3, "DOSE_NORMALIZED")} <= found
    d = {r.row: r for r in rows.decisions(cells, flags).collect()}
    assert d[1].decision == "verify" and d[1].warnings and d[2].decision == "accept" and d[3].decision == "verify"
    assert d[5].n_words == 0 and d[5].decision == "reject"
    want = Corrector(VOCAB, meds=MEDS, ocr=True).word("carbimzepole", "line", [])
    assert by_row(cells)[4, "line"].words[0].flag == want[2]


@pytest.mark.parametrize("ocr", [False, True])
def test_against_plain_python(spark, ocr):
    """Every signal given: columns' words, confirmed counts, chains of the corrected columns before, resonance."""
    clean = [("small", "ring chest"), ("small", "red bolt"), ("old", "anvil pain"), ("old", "cheap bolt"), ("old", "cheat bolt"), ("red", "chest pain"), ("red", "chest infection")]
    damaged = [("sma11", "r1ng chesl"), ("Smal", "rcd bo1t"), ("o1d", "anvi1 paln"), ("oId", "cheal b0lt"), ("0ld", "chea8 bolt."), ("red", "(chesf) paiin"), ("Red", "chect infecfion xyzzyplugh"), (None, "cheal"), ("", "che@l -- 3O2A 12.5"), ("old", "cheal rnedication")]
    chains = learn.chains(spark.createDataFrame(clean, "kind string, name string"), ["kind", "name"])
    column_words = {("kind", w) for k, _ in clean for w in [k]} | {("name", w) for _, n in clean for w in n.split()}
    freq = {"chest": 40, "bolt": 3, "gizmo": 2, "cheat": 1}
    res = {("cheal", "cheap"): 0.7, ("cheal", "cheat"): 0.6, ("rcd", "red"): 0.9}
    common = ["paln"]
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(damaged)], "id long, kind string, name string")
    edges = spark.createDataFrame([(a, b, x) for (a, b), x in res.items()], "a string, b string, resonance double")
    # the partners' discount is 0.6 + 0.08 resonance, at most 0.95
    discounted = {k: min(0.6 + 0.08 * x, 0.95) for k, x in res.items()}
    cells = rows.correct_rows(
        t, "id", ["kind", "name"], words(spark, VOCAB), spark.createDataFrame(sorted(column_words), "col string, word string"), spark.createDataFrame(sorted(freq.items()), "word string, n long"), chains, edges, words(spark, common),
        words(spark, MEDS), ocr=ocr,
    )
    table = {}
    for r in chains.collect():
        table.setdefault((r.ctx_col, r.ctx_val, r.tgt_col), {})[r.token] = r.n
    brute = Corrector(VOCAB, column_words, freq, table, discounted, common, MEDS, ocr)
    got = by_row(cells)
    for i, (kind, name) in enumerate(damaged):
        for col, (output, ws) in brute.row([("kind", kind), ("name", name)]).items():
            cell = got[i, col]
            assert cell.output == output, (i, col)
            assert [(w.flag, round(w.confidence, 6)) for w in cell.words] == [(f, round(c, 6)) for _, c, f in ws], (i, col)


def test_empty_and_learned_costs(spark):
    t = spark.createDataFrame([], "id long, line string")
    cells = rows.correct_rows(t, "id", ["line"], words(spark, VOCAB))
    flags = rows.cell_flags(cells, safety.ranges(spark), words(spark, MEDS))
    assert cells.count() == 0 and rows.decisions(cells, flags).count() == 0
    counts = spark.createDataFrame([("0,o", 20), ("1,l", 20), ("é,x", 5)], "pair string, n long")
    costs = learn.learned_costs(counts, 40)
    assert costs["0,o"] == pytest.approx(0.06) and costs["1,l"] == pytest.approx(0.08) and costs["m,n"] == STATIC_COSTS["m,n"] and "é,x" not in costs
