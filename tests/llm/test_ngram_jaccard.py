import random
import re

from textloom.llm import components, ngram_jaccard


def sets(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    s = {i: sets(t) for i, t in rows}
    parent = {i: i for i in s}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i, len(s[i]), find(i)) for i in s)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    rows, texts = [], []
    for i in range(n):
        k = r.random()
        if k < 0.45 or not texts:
            t = [r.choice(words) for _ in range(r.randrange(1, 160))]
            if r.random() < 0.6:
                t = t[: r.randrange(len(t) + 1)] + passage + t[len(t) // 2 :]
        else:
            t = list(r.choice(texts))
            for _ in range(r.randrange(0, 6)):
                t[r.randrange(len(t))] = r.choice(words)
        texts.append(t)
        rows.append((i * 3 + 1, " ".join(t) if i % 5 else "\n ".join(t).upper()))
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, component_id string, n int").repartition(3)
    return sorted(tuple(r) for r in ngram_jaccard.join(df, **options).collect())


def test_against_brute_force(spark):
    rows = corpus(1, 160) + [(9001, ""), (9002, None), (9003, "  \t"), (9004, "one two"), (9005, "One  two"), (9006, "é É"), (9007, "É é")]
    assert run(spark, rows) == brute(rows)


def test_common_shingles_leave_no_link_behind(spark):
    # with a limit of 2 nearly everything is common: longer prefixes and the plain join come in
    rows = corpus(2, 90)
    assert run(spark, rows, hot=2) == brute(rows)


def test_many_near_copies(spark):
    r = random.Random(4)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(2):
            t[r.randrange(len(t))] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(t)))
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_jaccard.join(df).collect()), key=str) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert ngram_jaccard.join(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_families_that_share_passages_are_not_paired(spark, monkeypatch):
    # near copies of two texts that have three tenths in common: all 300 * 300 pairs are out of the question, and none is made
    r = random.Random(9)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for family in "ab":
        base = [f"{family}{i}" for i in range(80)] + passage
        for _ in range(300):
            t = list(base)
            t[r.randrange(80)] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    seen, plain = [], ngram_jaccard.verified
    monkeypatch.setattr(ngram_jaccard, "verified", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    assert run(spark, rows) == [(i, 146, 0 if i < 300 else 300) for i in range(600)]
    assert sum(seen) < 20_000


def test_hashed_words():
    import pyarrow as pa

    from textloom.llm import meeting

    texts = ["", None, " a  b\tA\x0b", "é É x", "b", "long" * 400_000 + " a", " ", "a"]
    words, cuts = meeting.hashed_words(pa.array(["skipped", *texts]).slice(1))
    split = [(t or "").encode().lower().split() for t in texts]
    assert list(cuts) == [sum(map(len, split[:i])) for i in range(len(split) + 1)]
    flat = [w for s in split for w in s]
    assert len(set(zip(flat, words.tolist()))) == len(set(flat)) == len(set(words.tolist()))
    assert [list(h) for h in meeting.rolled_texts(words, cuts, 2)] == [list(meeting.rolled(words[a:z], 2)) for a, z in zip(cuts[:-1], cuts[1:])]
