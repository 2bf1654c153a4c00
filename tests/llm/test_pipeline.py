import random

import pytest

P = pytest.importorskip("public_tokenizers")


def test_run_against_a_brute_force_version(spark, tmp_path):
    import corpus_pipeline
    from tests.llm import test_ngram_jaccard as near
    from tests.llm.test_bpe import bpe
    from tests.llm.test_exact_dedup import exact_dedup  # noqa: F401
    from tests.llm.test_mixing import brute as mixed
    from tests.llm.test_quality import corpus
    from textloom.llm import mixing, quality

    docs, labels = corpus(300)
    r = random.Random(8)
    texts = [t for _, t, _ in docs]
    for i in range(0, 300, 3):  # copies and near copies
        t = texts[r.randrange(300)].split(" ")
        if len(t) > 40 and i % 2:
            t[5] = "other"
        texts[i] = ("  " if i % 4 else " ").join(t)
    rows = [(i, t, "en", f"src{i % 6}", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "src0", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    l = spark.createDataFrame(labels, "doc_id long, quality int")
    l.write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((x.doc_id, x.n_tokens) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model, f = quality.fit(d, l), quality.Featuriser()
    kept = [x for x in rows if 1 / (1 + 2.718281828459045 ** -model.margin(*quality._joined(f(x[1], x[4]), quality.BUCKETS))) >= 0.3]
    first = {}
    for x in kept:
        first.setdefault(" ".join((" " + (x[1] or "") + " ").split()) if (x[1] or "").strip() else x[1] or "", x)
    kept = [x for x in kept if x in first.values()]
    stay = {i for i, _, c in near.brute([(x[0], x[1]) for x in kept]) if i == c}
    kept = [x for x in kept if x[0] in stay]
    copies = mixed([(x[0], x[3], x[1]) for x in kept], mixing.WEIGHTS, mixing.SEED, mixing.BLOCK)
    e = bpe.Encoder(bpe.read_ranks(spark, P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    n = {x[0]: len(e.encode(x[1] or "")) for x in kept}
    assert got == sorted((i, n[i]) for i, _, _ in copies)
    assert 0 < len(got) < len(rows)


def test_stages_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
