import base64
import hashlib
import random
import struct

import pytest
import tiktoken

from textloom.llm import bpe

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n\n  \t x", "Hello world, it's  'll don't  we've", "naïve façade – Ünïcödé 你好 😀😀", "a" * 3000, "ab" * 2000, " " * 500 + "x", "1234567890 3.14", "<|endoftext|>", "é" * 700, "THTHER!! ONERSTAN!!", "\x00\x01\x7f", "x" * 40 + "\n" * 30]


def test_texts_as_the_library_does(ranks, reference):
    e, r = bpe.Encoder(ranks, P.PATTERN), random.Random(3)
    texts = TEXTS + ["".join(r.choice("abc  thern,.\n'éß0") for _ in range(r.randrange(200))) for _ in range(300)]
    for t in texts:
        ids = e.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert e.decode(struct.pack(f"<{len(ids)}I", *ids)) == t.encode()


def test_pairs_as_merging_has_them(ranks):
    v, r = bpe.Vocabulary(ranks), random.Random(1)
    for _ in range(5000):
        a, b = r.randrange(2000), r.randrange(2000)
        assert v.valid_pair(a, b) == (v.merged(v.bytes_of[a] + v.bytes_of[b]) == [a, b])


def test_appends_and_edits(ranks):
    v, r = bpe.Vocabulary(ranks), random.Random(2)
    for _ in range(60):
        data = bytes(r.choice(b"thern abc") for _ in range(r.randrange(1, 400)))
        t, cut = bpe.PrefixTable(v), r.randrange(len(data))
        t.append(data[:cut]).append(data[cut:])
        assert t.last == bpe.PrefixTable(v, data).last
        at, gone, new = r.randrange(len(data)), r.randrange(6), bytes(r.choice(b"thern ") for _ in range(r.randrange(6)))
        t.edit(at, min(gone, len(data) - at), new)
        whole = bpe.PrefixTable(v, data[:at] + new + data[at + min(gone, len(data) - at) :])
        assert t.data == whole.data and t.last == whole.last and t.tokens() == whole.tokens()


def test_an_edit_keeps_what_lies_behind(ranks):
    v = bpe.Vocabulary(ranks)
    t = bpe.PrefixTable(v, b"the cat sat on the mat " * 100)
    assert t.edit(10, 1, b"b") < 500


def test_append_to_a_text(ranks):
    e, r = bpe.Encoder(ranks, P.PATTERN), random.Random(6)
    for text, more in (("it'", "s fine"), ("we'r", "e"), ("a  ", "b"), ("", "x"), ("don", "'t"), ("x" * 5000, " y"), ("x" * 5000, "yz"), ("a b " * 5000, "c"), ("x", "")):
        assert bpe.GrowingText(e, text).append(more).ids() == e.encode(text + more)
    for _ in range(40):
        whole, growing = "", bpe.GrowingText(e)
        for _ in range(30):
            more = "".join(r.choice("ab  'streé1.\n") for _ in range(r.randrange(6)))
            whole += more
            assert growing.append(more).ids() == e.encode(whole)


def test_append_works_on_the_end_only(ranks):
    e = bpe.Encoder(ranks, P.PATTERN)
    growing = bpe.GrowingText(e, "the cat sat on the mat " * 20_000)
    assert sum(map(len, growing.open)) < 20
    table, read = bpe.PrefixTable(e.v, b"ab" * 20_000), []
    plain = e.v.ending

    class Watched:
        def iter(self, text):
            read.append(len(text))
            return plain.iter(text)

    e.v.ending = Watched()
    table.append(b"abab")
    assert read == [e.v.longest + 3] and table.last == bpe.PrefixTable(bpe.Vocabulary(ranks), b"ab" * 20_002).last


def test_many_tables_at_once(ranks):
    v, r = bpe.Vocabulary(ranks), random.Random(8)
    pieces = [" ".join(r.choice(["the", "rn", "é", "abc", "1", "\n", "tion"]) for _ in range(r.randrange(1, 8))).encode() for _ in range(500)] + [b"a", b"the", b"\x00\xff" * 9]
    tables = bpe.PrefixTables(v)
    want = [[v.ranks[p]] if p in v.ranks else bpe.PrefixTable(v, p).tokens() for p in pieces]
    for _ in range(2):
        assert tables.encode(pieces) == [struct.pack(f"<{len(w)}I", *w) for w in want]


def test_what_is_remembered_is_bounded():
    kept = bpe.Remembered(10)
    for i in range(100):
        if kept.known(i % 8) is None:
            kept[i % 8] = i
    assert all(kept.known(i) == i for i in range(8))
    for i in range(500):
        kept[i] = i
        assert kept.known(i) == i and len(kept) + len(kept.old) <= 20


def test_rows(spark, ranks, reference):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(99, None, 2), (None, "null id", 3), (0, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in bpe.digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
