import io
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import token_files as tf
from textloom.llm.storage import fresh_folder

JSON = tf.tokenizer_json(public_tokenizers.path("word_bpe_49k.json"))


def whole_ids(text):
    """The library on the whole text."""
    from tokenizers import Tokenizer

    global _tokenizer
    _tokenizer = globals().get("_tokenizer") or Tokenizer.from_str(JSON)
    return [*_tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_pack_round_trip(bits, ids):
    ids = np.array([i % (1 << bits) for i in ids], "<u4")
    data = tf.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (tf.unpack(data, bits, len(ids)) == ids).all()


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbZé\u0301 \n\t\u2000\u00a0\x1c.,'s0\u0130ΣΑ<|endoftext|>漢")), max_size=60))
def test_words_alone_give_the_whole_text(text):
    encoder = globals().setdefault("_encoder", tf.Encoder(JSON))
    found = list(encoder.runs([text, "", text]))
    assert [int(i) for d, run, _ in found if d == 0 for i in run] == whole_ids(text)[:-1] == [int(i) for d, run, _ in found if d == 2 for i in run]
    assert [last for *_, last in found].count(True) == 3


def test_file_random_access(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [(None if i == 3 else i - 5, rng.integers(0, 1 << 11, rng.integers(1, 90), dtype=np.uint32)) for i in range(40)]
    out = io.BytesIO()
    w = tf.Writer(out, 11, 32)
    for d, ids in docs:
        w.begin(d)
        w.add(ids[:7])
        w.add(ids[7:])
    w.close()
    f, flat = tf.TokenFile(out), np.concatenate([ids for _, ids in docs])
    assert f.docs == [d for d, _ in docs] and f.n_ids == len(flat)
    for i, (_, ids) in enumerate(docs):
        assert (f.document(i) == ids).all()
    for a, b in ((0, 1), (31, 33), (5, 700), (0, len(flat)), (len(flat) - 1, len(flat) + 9), (4, 4)):
        assert (f.ids(a, b) == flat[a:b]).all()
    for run in (1, 32, 50, 10**6):
        monkeypatch.setattr(tf, "RUN", run)
        again = [[] for _ in docs]
        for d, ids, _ in f.runs():
            again[d] += ids.tolist()
        assert again == [ids.tolist() for _, ids in docs]
    with pytest.raises(ValueError):
        tf.TokenFile(io.BytesIO(out.getvalue()[:-3]))


def brute(rows):
    out, at = [], 0
    for d, t in rows:
        ids = whole_ids(t)
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_against_the_library(spark):
    long = " ".join(f"Word{i % 97}, naïve" for i in range(60_000)) + " " + "x" * 5000
    rows = [(7, "Hello  WORLD"), (2, None), (3, ""), (-4, "é <|endoftext|> x\n\ty"), (9, long), (8, "漢字" * 400), (5, "\t \n")] + [(100 + i, "same words again") for i in range(50)]
    df = spark.createDataFrame([(d, t, "p", 1) for d, t in rows], "doc_id long, text string, part string, file int")
    folder = fresh_folder(spark, "test")
    manifest = tf.write(df, folder, JSON, files=5, block=64)
    assert 1 < manifest.count() <= 5 and sum(r.n_docs for r in manifest.collect()) == len(rows)
    want = brute(sorted(rows))
    assert sorted(tuple(r) for r in tf.read(manifest, folder).collect()) == sorted(want)
    ids = {r.doc_id: r.ids for r in tf.read(manifest, folder, with_ids=True).collect()}
    assert all(ids[d] == whole_ids(t) for d, t in rows)
    # a lost task's file is no part of the result
    fs, root = tf.file_system(folder)
    with open(os.path.join(root, "000001-stray.bits"), "wb") as f:
        f.write(b"half")
    assert sorted(tuple(r) for r in tf.read(manifest, folder).collect()) == sorted(want)
    assert tf.clear_strays(manifest, folder) == 1 and len(os.listdir(root)) == manifest.count()


def test_null_and_repeated_ids_and_empty(spark):
    rows = [(None, "a b"), (1, "x"), (1, "x"), (1, "y z"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = fresh_folder(spark, "test")
    got = sorted((tuple(r) for r in tf.read(tf.write(df, folder, JSON, files=3), folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 1, 1]
    assert sorted(r[3] for r in got) == sorted(r[3] for r in brute(rows)) and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    folder = fresh_folder(spark, "test")
    assert tf.read(tf.write(df.limit(0), folder, JSON), folder).collect() == []


def test_query(spark):
    got = sorted(tuple(r) for r in tf.op12_token_files(spark, "/root/testdata/sf0.001").collect())
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    assert got == brute(docs)


def test_words_of_latin_letters_are_put_together(monkeypatch):
    """Only marks, once each, and words of other characters go through the whole tokenizer; the ids stay those of the whole text."""
    encoder, asked = tf.Encoder(JSON), []
    whole = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda text: asked.append(text) or whole(text))
    text = "Été, éCLAIR été naïve. ÀÉÎÕÜßÿ ªµº Thé, naïve, x. 漢字 ét, ŷz" + " ñ" * 3 + " " + "é" * 70 + ","
    for _ in range(2):
        assert [i for _, run, _ in encoder.runs([text]) for i in run.tolist()] == whole(text).tolist()
    assert encoder.marked and set(asked[:2]) == {",", "."} and len(asked) == 3
    assert all(len(w) <= tf.LONGEST for w in encoder.young)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from([*map(chr, range(0xA0, 0x180)), *"aZ .,'̸́"]), max_size=40))
def test_words_of_latin_letters_give_the_whole_text(text):
    encoder = globals().setdefault("_encoder", tf.Encoder(JSON))
    assert [i for _, run, _ in encoder.runs([text]) for i in run.tolist()] == whole_ids(text)[:-1]
