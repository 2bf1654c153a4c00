import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators import align

WORDS = st.lists(st.text(alphabet="abdoO0il1tEé日\x7f", min_size=1, max_size=11), max_size=12)


def plain(a, b):
    """The moves of the plain alignment."""
    return [align.LEFT_OUT if j is None else align.PUT_IN if i is None else align.PAIR for i, j in align.path(a, b, align.token_cost)]


def check(pairs):
    found = dict(align.moves([a for a, _ in pairs], [b for _, b in pairs]))
    assert found == {k: plain(a, b) for k, (a, b) in enumerate(pairs)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), max_size=8), st.sampled_from([1, 40, 1 << 20]), st.sampled_from([0, 3, 32]))
def test_many_at_once_are_those_one_by_one(pairs, cells, few):
    kept = align.CELLS, align.FEW
    try:
        align.CELLS, align.FEW = cells, few
        check(pairs)
    finally:
        align.CELLS, align.FEW = kept


def test_texts_of_many_lengths():
    rng = random.Random(7)
    text = lambda n: ["".join(rng.choices("abdeiotn", k=rng.choice((1, 2, 5, 8, 9, 14, 29)))) for _ in range(n)]
    check([(text(n), text(m)) for n, m in ((1, 1), (1, 40), (40, 1), (33, 31), (31, 33), (64, 20), (0, 5), (5, 0), (0, 0))])


def test_pairs_of_words_cost_little():
    rng = random.Random(3)
    text = lambda: ["".join(rng.choices("abdeiotnrs", k=rng.randint(3, 8))) for _ in range(90)]
    a, b = [text() for _ in range(150)], [text() for _ in range(150)]
    began = time.process_time()
    assert len(list(align.moves(a, b))) == 150
    # 1.2 million pairs of words; one by one they took over 8 s
    assert time.process_time() - began < 4


def test_evaluated(spark):
    rows = [(1, "the cat sat", "the cot sat on"), (1, None, "x"), (2, "", None), (3, "a b", "a b")]
    got = align.evaluated(spark.createDataFrame(rows, "k int, p string, q string"), "p", "q", "k")
    assert got.schema["total"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, got.collect())) == [(1, 5, 2, 1, 0, 2), (3, 2, 2, 0, 0, 0)]
