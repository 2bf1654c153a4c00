from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import lcs


def table(a, b):
    """The whole table, and the way back through it."""
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if x == y else max(dp[i - 1][j], dp[i][j - 1])
    i, j, found = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.append(j - 1)
            i, j = i - 1, j - 1
        elif dp[i - 1][j] >= dp[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return dp[-1][-1], sorted(found)


WORDS = st.lists(st.sampled_from("abcd"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_against_whole_table(a, b):
    n, places = table(a, b)
    assert lcs.length(a, b) == n == lcs.length(b, a)
    assert lcs.matched(a, b) == places


def test_flips(spark):
    rows = [
        (1, ["a", "b", "c"], ["a", "x", "y"], ["a", "y", "c"]),  # y is won, c is lost
        (2, ["Doctor", "sees", "pat1ent"], ["doctor", "sees", "patient"], ["doctor", "sees", "the", "patient"]),
        (3, None, ["a"], ["a"]),
        (4, ["a"], [], None),
        (5, ["a", "a", "a"], ["a"], ["a", "a"]),
    ]
    df = spark.createDataFrame(rows, "id int, x array<string>, y array<string>, t array<string>")
    got = {r.id: tuple(r.f) for r in df.select("id", lcs.flips(F.col("x"), F.col("y"), F.col("t")).alias("f")).collect()}
    assert got == {1: (3, 2, 2, 1, 1), 2: (4, 2, 3, 1, 0), 3: (1, 0, 1, 1, 0), 4: (0, 0, 0, 0, 0), 5: (2, 2, 1, 0, 1)}


def test_long_lists():
    a, b = [str(i % 997) for i in range(6000)], [str(i % 991) for i in range(5000)]
    places = lcs.matched(a, b)
    assert len(places) == lcs.length(a, b) and places == sorted(set(places))
