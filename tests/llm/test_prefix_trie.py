import hashlib
import random
import zlib

import pytest

from textloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner string, a int"


def brute(rows, block=100, shared=6):
    """The trie by plain dictionaries."""
    of = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            of.setdefault(c, []).append((t is not None, t, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), (r, x)))
    of = {c: [x[3] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, v in of.items()}
    convs = {}
    for c, own in of.items():
        base = c - (abs(c) % block if c >= 0 else -(abs(c) % block))
        h = 0 if base == c else zlib.crc32(str(c).encode()) % shared
        convs[c] = tuple(of.get(base, [])[:h] + own[h:])
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children = {}
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        below = children.get(n, [])
        leaves[n] = sum(leaves[x] for x in below) or 1
        saved[n] = sum(saved[x] for x in below) + (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)
    end = lambda n: ",".join(str(c) for c in sorted(c for c in members[n] if len(convs[c]) == len(n)))
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n], hashlib.sha256(end(n).encode()).hexdigest()) for n, m in members.items())


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "d", "o", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in pt.trie(df, **how).collect())


def some(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "é漢", "", None])) for c in rng.sample(range(-120, 320), 90) for t in range(rng.randint(1, 8))]
    # ties, repeated rows, null turns, null conversations
    rows += rng.sample(rows, 40) + [(c, None, "user", "a") for c in (1, 2, 200, 201)] + [(None, 1, "user", "x")] * 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    assert run(spark, some(seed)) == brute(some(seed))


def test_long_conversation_and_deep_comb(spark):
    """One conversation holds most rows; others leave it one turn after the other, so the trie is 1,500 deep. Few rounds of messages."""
    rows = [(1, t, "u", f"t{t}") for t in range(1500)]
    rows += [(100 * (i + 1), t, "u", f"t{t}") for i in range(40) for t in range(i)] + [(100 * (i + 1), 9999, "u", f"own{i}") for i in range(40)]
    rounds = []
    real = pt.written
    try:
        pt.written = lambda df, name: (rounds.append(name), real(df, name))[1]
        assert run(spark, rows, block=1 << 40, shared=1) == brute(rows, 1 << 40, 1)
    finally:
        pt.written = real
    assert rounds.count("paths") < 14


def test_copies_turnless_and_empty(spark):
    copies = [(1000 + 100 * c, t, "user", f"same {t}") for c in range(300) for t in range(3)]
    # 101 .. 199 without a base: with enough borrowed turns nothing is left
    lost = [(c, 0, "user", "only") for c in range(101, 120)]
    for rows in (copies, lost, copies + lost):
        assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] == run(spark, [(None, 1, "u", "x")])


def test_ends_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 7)
    rows = [(100 * c, 0, "u", "hi") for c in range(-50, 150)]
    assert run(spark, rows) == brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in pt.op13_prefix_trie(spark, "/root/testdata/sf0.001").collect()) == brute(rows)
