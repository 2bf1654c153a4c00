import hashlib
import math

from textloom.llm import mixing

WEIGHTS = {"a": 0.9, "b": 0.05, "other": 0.05}


def brute(rows, weights, seed, block):
    of = lambda s: s if s in weights and s != "other" else "other"
    size = lambda t: len((t or "").encode())
    total, out = sum(size(r[2]) for r in rows), []
    for i, source, _ in rows:
        own = sum(size(r[2]) for r in rows if of(r[1]) == of(source))
        rate = weights[of(source)] / sum(weights.values()) * total / own if own else 1.0
        draws = max(1, math.ceil(rate / block))
        n = 0
        for j in range(draws):
            u = int(hashlib.md5(f"{seed}:{'null' if i is None else i}:{j}".encode()).hexdigest()[:13], 16) / (1 << 52)
            p = c = math.exp(-rate / draws)
            k = 0
            while c <= u and k < 1000:
                k += 1
                p *= rate / draws / k
                c += p
                n += 1
        out += [(i, k, n) for k in range(1, n + 1)]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [(i, "ab"[i % 2] if i % 7 else None, "word " * (1 + i % 30) if i % 11 else None) for i in range(400)] + [(None, "a", ""), (3, "b", "x"), (3, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for weights, block in ((WEIGHTS, 16.0), ({"b": 30.0, "other": 1.0}, 0.5)):
        got = sorted(((r.doc_id, r.copy, r.n_copies) for r in mixing.replicate(df, weights, 5, block).collect()), key=str)
        assert got == brute(rows, weights, 5, block)


def test_shares_and_shuffle(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "if(id % 10 = 0, 'b', 'a') as source", "'0123456789' as text", "1 as rate", "id as __k")
    out = mixing.replicate(df, {"a": 0.5, "b": 0.5})
    assert out.columns == ["doc_id", "source", "text", "__k", "copy", "n_copies", "rate", "shuffle_key"]
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] / (n["a"] + n["b"]) - 0.5) < 0.02 and abs(n["a"] + n["b"] - 20000) < 600
    ids = [r.doc_id for r in out.collect()]
    up = sum(x < y for x, y in zip(ids, ids[1:], strict=False)) / len(ids)
    assert 0.45 < up < 0.55


def test_empty_and_textless(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.replicate(df).count() == 0
    df = spark.createDataFrame([(i, "a", None) for i in range(500)], "doc_id long, source string, text string")
    assert 400 < mixing.replicate(df, {"a": 1.0}).count() < 600


def test_any_column_names_and_very_many_copies(spark):
    names = ["__class", "__u", "__rate", "__copy", "__n", "__row", "__block", "rate", "Copy"]
    df = spark.createDataFrame([(i, "b" if i else "a", "0" * (1 if i else 100_000), *names) for i in range(5)], "doc_id long, source string, text string, " + ", ".join(f"{n} string" for n in names))
    out = mixing.replicate(df, {"a": 0.5, "b": 0.5})
    assert out.columns == ["doc_id", "source", "text", *names[:-2], "copy", "n_copies", "rate", "shuffle_key"]
    got = out.select("doc_id", "copy", "n_copies", "__n").collect()
    for i in range(1, 5):
        copies = sorted(r.copy for r in got if r.doc_id == i)
        assert len(copies) > 10_000 and copies == list(range(1, len(copies) + 1)) and {(r.n_copies, r["__n"]) for r in got if r.doc_id == i} == {(len(copies), "__n")}
    assert mixing.mixed(df).columns == df.columns


def test_dotted_and_quoted_names(spark):
    df = spark.createDataFrame([(i, "web", "some text", f"x{i}", f"y{i}") for i in range(20)], ["doc_id", "source", "text", "a.b", "c`d"])
    rows = mixing.replicate(df).collect()
    assert rows and all((r["a.b"], r["c`d"]) == (f"x{r.doc_id}", f"y{r.doc_id}") for r in rows)
    assert mixing.mixed(df).columns == df.columns
