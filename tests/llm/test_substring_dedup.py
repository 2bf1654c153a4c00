import itertools
import random

from textloom.llm import substring_dedup as s


def test_chains_against_all_subsets():
    r = random.Random(5)
    for _ in range(200):
        anchors = [(r.randrange(60), r.randrange(60), r.randrange(3, 9)) for _ in range(r.randrange(1, 8))]

        def worth(chain):
            total = chain[0][2]
            for (x, y, w), (x2, y2, w2) in zip(chain, chain[1:], strict=False):
                if x + w > x2 or y + w > y2:
                    return -1
                total += w2 - s.GAP_COST * (x2 - x - w + y2 - y - w)
            return total

        best = max(worth(list(c)) for n in range(1, len(anchors) + 1) for c in itertools.permutations(anchors, n))
        found = s.chains(anchors, jump=10**6)
        assert abs(worth(found[0]) - best) < 1e-9
        assert sorted(a for c in found for a in c) == sorted(anchors)


def test_chains_within_the_jump():
    r = random.Random(6)
    for _ in range(300):
        anchors = list({(r.randrange(250), r.randrange(250), r.choice([6, 12, 100])) for _ in range(r.randrange(1, 8))})

        def worth(chain):
            total = chain[0][2]
            for (x, y, w), (x2, y2, w2) in zip(chain, chain[1:], strict=False):
                if not (0 <= x2 - x - w <= s.JUMP and 0 <= y2 - y - w <= s.JUMP):
                    return -1
                total += w2 - s.GAP_COST * (x2 - x - w + y2 - y - w)
            return total

        best = max(worth(list(c)) for n in range(1, len(anchors) + 1) for c in itertools.permutations(anchors, n))
        assert abs(worth(s.chains(anchors)[0]) - best) < 1e-9
    # a long passage far before doesn't hide the pieces of the next
    assert s.chains([(0, 0, 200), (300, 300, 15), (317, 318, 15), (334, 336, 15)])[1] == [(300, 300, 15), (317, 318, 15), (334, 336, 15)]


def test_common_length():
    import numpy as np

    assert s.common_length(np.array([1, 2, 3, 4]), np.array([2, 9, 4])) == 2
    assert s.common_length(np.array([]), np.array([1])) == 0


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    rows, planted = [], {}
    passages = [text(60) for _ in range(3)]
    for i in range(80):
        t = text(r.randrange(0, 200))
        if i % 4 == 0:
            p = list(passages[i // 4 % 3])
            if i % 8 == 0:  # a fuzzy copy: one word other, one gone, one put in
                p[20] = word()
                del p[40]
                p.insert(50, word())
            at = r.randrange(len(t) + 1)
            planted[i] = (i // 4 % 3, at, at + len(p))
            t = t[:at] + p + t[at:]
        rows.append((i, " ".join(t)))
    return rows, planted


def test_planted_passages(spark):
    rows, planted = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source_id string").repartition(3)
    found = s.passages(df).collect()
    first = {p: min(i for i in planted if planted[i][0] == p) for p in range(3)}
    assert {r.doc_id for r in found} == set(planted) - set(first.values())
    assert {r.source_id for r in found} <= set(planted)
    for r in found:
        p, begin, end = planted[r.doc_id]
        assert planted[r.source_id][0] == p and r.source_id < r.doc_id
        assert abs(r.begin - begin) <= 3 and abs(r.end - end) <= 3 and r.equal > 0.9


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b"), (4, long), (5, long.upper()), (None, long), (4, long), (6, "a " * 300), (7, "a " * 300)]
    found = s.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_id) for r in found} == {(5, 4), (7, 6)}
    assert {r.words for r in found if r.doc_id == 5} == {30_000}
    assert s.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_with_other_words_between(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    rows, planted = [], {}
    for case, (n, size, between) in enumerate([(2, 45, 24), (3, 45, 20), (4, 50, 20)]):
        parts = [text(size) for _ in range(n)]
        for doc in (2 * case, 2 * case + 1):
            rows.append((doc, " ".join(text(30) + [w for p in parts for w in p + text(between)])))
        planted[2 * case + 1] = [(30 + i * (size + between), 30 + i * (size + between) + size) for i in range(n)]
    found = s.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for doc, at in planted.items():
        held = {w for f in found if f.doc_id == doc for w in range(f.begin, f.end)}
        assert held >= {w for begin, end in at for w in range(begin, end)} and {min(held), max(held) + 1} == {at[0][0], at[-1][1]}
    assert all(f.equal >= 0.8 and f.words >= 40 and f.source_id == f.doc_id - 1 for f in found)
    assert sorted((f.begin, f.end) for f in found if f.doc_id == 1) == planted[1]


def test_cut_against_all_stretches():
    r = random.Random(8)
    for _ in range(200):
        found, x, y = [], 0, 0
        for _ in range(r.randrange(1, 40)):
            found.append((x, y))
            x, y = x + r.choice([1, 1, 1, 1, 2, 5]), y + r.choice([1, 1, 1, 1, 3, 4])
        words = lambda i, j: max(found[j][0] - found[i][0], found[j][1] - found[i][1]) + 1  # noqa: B023, E731
        fits = lambda i, j: words(i, j) >= 8 and 10 * (j - i + 1) >= 8 * words(i, j)  # noqa: B023, E731
        cuts = s.cut(found, 8, 0.8)
        assert all(fits(*c) for c in cuts)
        every = {p for i in range(len(found)) for j in range(i, len(found)) if fits(i, j) for p in range(i, j + 1)}
        assert every == {p for i, j in cuts for p in range(i, j + 1)}


def test_recall_of_changed_passages(spark):
    """Passages of 60 words, every n-th one changed, in other text."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    rows, every = [], {}
    for case in range(180):
        n = (5, 7, 8, 10, 12, 60)[case % 6]
        p = text(60 if n < 60 else 40)
        changed = [w if (i + 1 + case // 6) % n or n == 60 else word() for i, w in enumerate(p)]
        rows += [(2 * case, " ".join(text(50) + p + text(50))), (2 * case + 1, " ".join(text(30) + changed + text(70)))]
        every[2 * case + 1] = n
    found = {f.doc_id for f in s.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {n: sum(i in found for i in every if every[i] == n) / 30 for n in sorted(set(every.values()))}
    assert found <= set(every) and set(recall.values()) == {1}


def test_parts_that_stand_first_elsewhere(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    p = text(50)
    # all 4-mers of p, those across the border too, stand in documents before the first that has p
    parts = [p[:25], p[25:], p[15:35], p, p[:25], p[25:], p, p]
    docs = [(i, " ".join(text(20) + q + text(20))) for i, q in enumerate(parts)]
    found = s.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {f.doc_id for f in found} == {6, 7} and all((f.begin, f.end, f.source_begin, f.equal) == (20, 70, 20, 1) for f in found)


def test_partitions_and_batches_decide_nothing(spark):
    r = random.Random(12)
    rows, _ = corpus()
    line = " ".join(f"line{i}" for i in range(45))
    rows += [(100 + i, f"{line} {i} " + " ".join(r.choice("abcdefgh") * 3 for _ in range(30)) + (f" {line}" if i % 3 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before, got = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for parts, size, frequent in ((1, 1000, 32), (7, 1000, 32), (3, 10, 2), (1, 1000, 2)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got.append(sorted(tuple(x) for x in s.passages(df.repartition(parts), frequent=frequent).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] and all(g == got[0] for g in got)


def test_matches_against_a_brute_force_version(spark):
    rows, _ = corpus()
    rows = [(i, " ".join(t.split()[:30] + ["x", "y", "z", "x", "y", "z"])) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, first = set(), {}
    for i, t in sorted(rows):
        w = t.split()
        for at in range(len(w) - 3):
            d, p = first.setdefault(tuple(w[at : at + 4]), (i, at))
            if d != i:
                want.add((i, at, d, p))
    for frequent in (32, 2):
        found, _ = s.matches(df, 4, 1, 40, 24, frequent)
        assert {(r.doc, r.place, r.source, r.source_place) for r in found.where("not long").collect()} == want


def test_extensions_of_many_pairs_are_those_of_each():
    import numpy as np

    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 3, n).astype(np.uint64) for n in (0, 1, 5, 70, 300, 1200)]
    for i in range(3, 6):  # a copy with words changed, left out and put in
        t = texts[i].copy()
        t[rng.random(len(t)) < 0.05] += np.uint64(7)
        texts.append(np.insert(np.delete(t, [20, 41]), 50, [9, 9]))
    words = s.Words(texts)
    asked = [(i, j, int(rng.integers(len(texts[i]) + 1)), int(rng.integers(len(texts[j]) + 1))) for i in range(len(texts)) for j in range(len(texts)) for _ in range(6)]
    asked += [(i, i + 3, 0, 0) for i in range(3, 6)]
    ai, bi, x, y = (np.array(c) for c in zip(*asked, strict=True))
    for reach in (60, 400):
        forward, backward = s.ends(words, ai, words, bi, x, y, x, y, reach)
        for n, (i, j, u, v) in enumerate(asked):
            assert tuple(int(c[n]) for c in forward) == s.extended(texts[i][u:], texts[j][v:], reach)[:3]
            assert tuple(int(c[n]) for c in backward) == s.extended(texts[i][:u][::-1], texts[j][:v][::-1], reach)[:3]


def test_common_length_is_that_of_the_table():
    import numpy as np

    rng = np.random.default_rng(6)
    for n, m in itertools.product((0, 1, 7, 90), repeat=2):
        a, b = rng.integers(0, 6, n), rng.integers(0, 6, m)
        table = np.zeros((n + 1, m + 1), int)
        for i, j in itertools.product(range(n), range(m)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert s.common_length(a, b) == table[n, m] == len(s.common_places(a, b))


def test_packed_columns_compress():
    """Ids of eight bytes and places of four hardly differ in their high bytes: packed, these lie together and take no space once compressed."""
    import zlib

    import numpy as np

    from textloom.llm import meeting

    rng = np.random.default_rng(1)
    n = 20_000
    tokens, doc, place = rng.integers(0, 1 << 48, n, dtype=np.uint64), np.sort(rng.integers(10**6, 10**6 + 1000, n)).astype("<i8"), rng.integers(0, 2000, n).astype("<u4")
    batch = meeting.packed(tokens, {"doc": doc, "place": place}, 24)
    got, more = meeting.met([batch], {"doc": "<i8", "place": "<u4"})
    assert sorted(zip(got.tolist(), more["doc"].tolist(), more["place"].tolist())) == sorted(zip(tokens.tolist(), doc.tolist(), place.tolist()))
    assert meeting.met([batch.slice(0, 0)], {"doc": "<i8", "place": "<u4"}) is None
    size = sum(len(zlib.compress(x, 1)) for c in batch.columns[3:] for x in c.to_pylist())
    assert size < 3.9 * n
