import os

import pytest
from pyspark.sql import functions as F

from textloom.operators import landscape, layout, privacy
from textloom.sources import ingest
from textloom.streaming import events


def test_redaction(spark):
    t = "Patient MRN: 12345678, DOB: 15/03/1990, Civil ID 198765432109, phone +965 9876 5432"
    df = spark.createDataFrame([(1, t)], "id int, text string")
    out = df.select(privacy.redact(F.col("text")).alias("r")).first().r
    assert all(x not in out for x in ("12345678", "15/03/1990", "198765432109", "9876 5432")) and "[[CID]]" in out
    found = privacy.findings(df, "id", "text").collect()
    assert {r.token for r in found} >= {"[[CID_0000]]", "[[MRN_0001]]", "[[DOB_0002]]"}


def test_csv_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Patient,Diagnosis\nBader,"stroke, ischemic"\nAli,"two\nlines"\n Omar ,\n')
    rows = {r.Patient: r.Diagnosis for r in ingest.delimited(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {"Bader": "stroke, ischemic", "Ali": "two\nlines", "Omar": ""}
    (tmp_path / "x").write_bytes(b"%PDF-1.4")
    (tmp_path / "y").write_bytes(b"\x89PNG....")
    (tmp_path / "z").write_bytes(b"plain")
    types = {os.path.basename(r.path): r.type for r in ingest.directory(spark, str(tmp_path)).collect()}
    assert types == {"a.csv": "csv", "x": "pdf", "y": "image", "z": "text"}


def test_state(spark, tmp_path):
    at = f"file://{tmp_path}/state"
    assert ingest.load_state(spark, at, 1) is None
    ingest.save_state({"words": spark.createDataFrame([("a", 1)], "w string, n int")}, at, 1)
    assert ingest.load_state(spark, at, 1)["words"].first().w == "a" and ingest.load_state(spark, at, 2) is None


def test_islands(spark):
    p = spark.createDataFrame([(1, x) for x in (0, 10, 15, 100, 105, 300)], "g int, x int")
    assert {r.x: r.island for r in layout.islands(p, "g", "x", 20).collect()} == {0: 1, 10: 1, 15: 1, 100: 2, 105: 2, 300: 3}
    assert [(r["from"], r["to"], r.n) for r in layout.columns(p, "g", "x").collect()] == [(0, 15, 3)]


def test_landscape(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [0.2, 0.0], 0), (3, [5.0, 5.0], 1), (4, [5.2, 5.0], 1)], "vec_id int, embedding array<double>, label int")
    fit = landscape.fit(v)
    best = {r.vec_id: (r.predicted, r.confidence) for r in landscape.best(landscape.scores(v, landscape.model(fit))).collect()}
    assert [best[i][0] for i in (1, 2, 3, 4)] == [0, 0, 1, 1] and all(0 <= c <= 1 for _, c in best.values())
    assert landscape.fit(v.where("vec_id = 1")).first()["var"] == 2.0
    far = spark.createDataFrame([(9, [99.0, 0.0], 0)], "vec_id int, embedding array<double>, label int")
    assert landscape.rejection(far, landscape.model(fit)).first().rejected


def test_votes(spark):
    v = spark.createDataFrame([(1, "a", "x", 0.9, 1.0), (1, "b", "x", 0.5, 1.0), (1, "c", "y", 0.8, 1.0)], "vec_id int, engine string, label string, confidence double, weight double")
    r = landscape.vote(v).first()
    assert r.label == "x" and round(r.agreement, 3) == 0.667 and 0 <= r.confidence <= 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:{i % 60:02d}:00", "ab"[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((str(r.begin), r.event_type, r.n) for r in events.tumbling(events.stream_of(spark, str(tmp_path), "events")).collect())
    want = sorted((str(r.b), r.event_type, r["count"]) for r in df.groupBy(F.date_trunc("hour", "ts").alias("b"), "event_type").count().collect())
    assert got == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_every_query_runs_and_has_its_columns(spark):
    import duckdb

    from textloom.plans import registry

    d, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("word_freq", "next_word_pairs", "fuzzy_top1", "lab_range_flags", "context_chains", "landscape_predict", "lookback_lab", "decayed_bigrams"):
        got, want = registry.QUERIES[name](spark, d), c.execute(registry.SQL[name])
        assert sorted(got.columns) == sorted(x[0] for x in want.description)
        assert got.count() == len(want.fetchall())
    assert set(registry.SQL) <= set(registry.QUERIES)
