from textloom.llm import substring_dedup as s


def test_runs_whose_parts_stand_first_elsewhere(spark):
    """Two documents share 40 words; all but the first and all but the last of these stand in earlier documents, so each shorter seed has another first."""
    run = [f"r{i}" for i in range(40)]
    fill = lambda d, n: [f"f{d}x{i}" for i in range(n)]
    texts = {1: fill(1, 20) + run[:39] + fill(2, 20), 2: fill(3, 20) + run[1:] + fill(4, 20), 3: fill(5, 9) + run + fill(6, 9), 4: fill(7, 5) + run + fill(8, 7)}
    found = s.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.begin, r.end, r.source_begin, r.source_end) for r in found if r.source_id == 3] == [(4, 5, 45, 9, 49)]


def test_a_run_in_many_documents_over_many_batches(spark):
    """Every document with the run is matched with the first one, also where the run's rows go on in the next batches and its place differs."""
    run = [f"h{i}" for i in range(44)]
    texts = {d: [f"p{d}x{i}" for i in range(d % 4)] + run for d in range(9, 30)}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string").repartition(5)
    found = spark.createDataFrame([(d, d % 4 + 3, 9, 4, True) for d in range(10, 30)], "doc long, place long, source long, source_place long, long boolean")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        more, table = s.whole_runs(docs, found, 40)
        got = {(r.doc, r.place, r.source, r.source_place) for r in more.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert got == {(d, d % 4 + i, 9, 1 + i) for d in range(10, 30) for i in range(4)}
    assert table.columns == ["doc", "place", "source", "source_place"]  # matches alone are written, not every run
