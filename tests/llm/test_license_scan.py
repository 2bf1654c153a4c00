import random
import re

from textloom.llm import license_scan as ls


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in ls.BASE:
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places_against_brute_force(spark):
    r = random.Random(6)
    words = ["cc", "by", "CC", "all", "rights", "reserved", "General", "public", "license", "x", "é", "K", "4.0", "-", "cc-by", "İ"]
    rows = [(i, r.choice([" ", ", ", "\n"]).join(r.choice(words) for _ in range(r.randrange(60)))) for i in range(200)] + [(900, None), (901, ""), (902, "cc by " * 5000), (3, "cc by"), (3, "cc by"), (None, "All rights, reserved")]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, n_words int, labels string")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in ls.scan(df).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert ls.scan(df.limit(0)).count() == 0


def test_fuzzy_spans(spark):
    rows = [
        (1, "foo. Licensed under the Apache License, Version 2.0. bar"),
        (2, "licensed under the new apache license version 2 0"),  # a word put in
        (3, "licensed under the apache license"),  # four of seven 2-grams
        (4, "the apache was licensed and the version under two"),
        (5, "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = {r.doc_id: (set(filter(None, r.labels.split(","))), r.score) for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ({"apache-2.0"}, 1.0)
    assert got[2][0] == {"apache-2.0"} and got[2][1] < 1
    assert got[3][0] == set() and got[4][0] == set()
    assert {"gpl", "gpl-3.0"} <= got[5][0]
    assert all(0 <= s <= 1 for _, s in got.values())
