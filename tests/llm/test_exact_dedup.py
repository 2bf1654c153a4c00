from pyspark.sql import functions as F

from textloom.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, __x int"


def brute(rows):
    import hashlib
    import re

    norm = [re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows]
    out = []
    for r, t in zip(rows, norm, strict=True):
        ids = [x[0] for x, y in zip(rows, norm, strict=True) if y == t and x[0] is not None]
        out.append((r[0], min(ids) if ids else None, sum(y == t for y in norm), r[0] == (min(ids) if ids else None), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a  b", "c", 1), (3, "a\tb", "c", 1), (9, "a b ", None, 2), (1, None, None, 3), (2, "", None, 3), (4, "é" * 50_000, None, 3), (8, "é" * 50_000, None, 3), (7, "\n\n", "", 0), (6, " ", "", 0), (None, "a b", "", 0), (None, "alone", "", 0), (3, "a\tb", "c", 1)]


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = brute(ROWS)
    for hashed in (exact_dedup.content_hash, lambda t: (F.length(t) % 2).cast("string").cast("binary")):
        got = sorted((tuple(r) for r in exact_dedup.mark(df, hashed=hashed).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
        assert got == want


def test_keeps_columns_and_empty_table(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert exact_dedup.deduplicate(df).columns == df.columns
    assert {r.doc_id for r in exact_dedup.deduplicate(df).collect()} == {3, 9, 1, 4, 6, None}
    assert exact_dedup.mark(df.limit(0)).count() == 0


def test_any_column_names(spark):
    names = ["__id", "__both", "__keep", "__row", "__raw", "__text", "__key", "kept", "Keep_Id"]
    df = spark.createDataFrame([(2, "a  b", *names), (1, "a b", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = exact_dedup.mark(df)
    assert out.columns == ["doc_id", "text", *names[:-2], "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r.doc_id, r["__both"], r.keep_id, r.kept) for r in out.collect()) == [(1, "__both", 1, True), (2, "__both", 1, False)]
    stay = exact_dedup.deduplicate(df)
    assert stay.columns == df.columns and [tuple(r) for r in stay.collect()] == [(1, "a b", *names)]


def test_dotted_and_quoted_names(spark):
    df = spark.createDataFrame([(2, "a  b", "x", "y"), (1, "a b", "z", "w")], ["doc_id", "text", "a.b", "c`d"])
    assert sorted((r.doc_id, r["a.b"], r["c`d"], r.kept) for r in exact_dedup.mark(df).collect()) == [(1, "z", "w", True), (2, "x", "y", False)]
    assert exact_dedup.deduplicate(df).columns == df.columns
