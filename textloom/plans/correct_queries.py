"""Queries of the correction pipeline: the vocabulary is the words of `part`, damaged the way scanners do."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.distance import CORE_COSTS, STATIC_COSTS, weighted_distance
from textloom.functions.lcs import lcs_length
from textloom.operators import correct as c
from textloom.sources.storage import stored
from textloom.sources.tables import table

#: Look-alikes that a scanner takes for each other, in turn; every word is damaged by the rule that its checksum picks.
NOISE_FROM, NOISE_TO = "oilsebg", "011538g"


def _vocab(spark, sf_dir):
    """Words of the parts' names, and the documents' words that occur 40 times or more."""
    part = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    docs = table(spark, sf_dir, "documents").select(F.explode(tx.model_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 40").select("word")
    return part.unionByName(docs).where(F.length("word") >= 3).where(F.col("word").rlike("^[a-z]+$")).distinct()


def _written_vocab(spark, sf_dir):
    """The vocabulary, written: a plan that asks for it several times reads the documents once."""
    return stored(_vocab(spark, sf_dir), "vocab")


def _noisy(vocab):
    """word, query: look-alike digits, or m as rn, or a letter dropped."""
    k = F.ascii(F.substring("word", 2, 1)) % 3
    q = F.when(k == 0, F.translate("word", NOISE_FROM, NOISE_TO)).when(k == 1, F.replace(F.col("word"), F.lit("m"), F.lit("rn"))).otherwise(F.concat(F.substring("word", 1, 2), F.expr("substring(word, 4)")))
    return vocab.select("word", q.alias("query"))


def deletion_index(spark, sf_dir):
    v = _vocab(spark, sf_dir).withColumn("form", tx.index_form(F.col("word")))
    return v.select(F.explode(tx.deletions(F.col("form"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def blocking_candidates(spark, sf_dir):
    v = _written_vocab(spark, sf_dir)
    return c.candidates(_noisy(v), v).groupBy("query").agg(F.count("*").alias("n"), F.max("shape").alias("best_shape"))


def shape_score(spark, sf_dir):
    v = _noisy(_vocab(spark, sf_dir))
    return v.select("word", "query", c.shape_score(F.col("query"), tx.index_form(F.col("query")), F.col("word"), tx.index_form(F.col("word"))).alias("shape"))


def weighted_distances(spark, sf_dir):
    v = _noisy(_vocab(spark, sf_dir))
    return v.select("word", "query", F.round(weighted_distance(F.col("query"), F.col("word"), STATIC_COSTS), 6).alias("static"), F.round(weighted_distance(F.col("query"), F.col("word"), CORE_COSTS), 6).alias("core"), F.levenshtein("query", "word").alias("plain"))


def _ranked(spark, sf_dir, k):
    v = _written_vocab(spark, sf_dir)
    n = _noisy(v)
    pairs = c.with_distance(c.candidates(n.select("query"), v)).where(F.col("distance") <= c.max_distance(F.length("query")))
    return n, c.ranked(c.score(pairs), k)


def fuzzy_top1(spark, sf_dir):
    n, r = _ranked(spark, sf_dir, 1)
    best = r.select("query", F.col("word").alias("best"), F.round("distance", 6).alias("distance"))
    return n.join(best, "query", "left").select("query", "word", "best", "distance", (F.col("best") == F.col("word")).alias("right"))


def fuzzy_signals_score(spark, sf_dir):
    _, r = _ranked(spark, sf_dir, c.TOP)
    return r.select("query", "word", "rank", F.round("distance", 6).alias("distance"), "edit", *[F.round(f"s{i}", 6).alias(f"s{i}") for i in (1, 6, 7)], F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


def evidence_gate(spark, sf_dir):
    _, r = _ranked(spark, sf_dir, 1)
    return r.select("query", "word", c.evidence_gate(F.col("query"), F.round("distance", 9), F.col("edit"), F.col("word")).alias("keep"), c.evidence_gate(F.col("query"), F.round("distance", 9), F.col("edit"), F.col("word"), True).alias("keep_ocr"))


def guard_flags(spark, sf_dir):
    """Tokens of the documents by the flag of the first guard that settles them."""
    t = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n\t]+")).alias("token"))
    return t.select(c.guard(F.col("token")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def peel_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n\t]+")).alias("token"))
    lead, core, trail = tx.peel(F.col("token"))
    return t.select(lead.alias("lead"), trail.alias("trail"), F.length(core).alias("len")).groupBy("lead", "trail").agg(F.count("*").alias("n"), F.sum("len").alias("core_chars"))


def correction_flags(spark, sf_dir):
    """How all the damaged words, and as many sound ones, are flagged."""
    v = _written_vocab(spark, sf_dir)
    n = _noisy(v)
    meds = v.where(F.length("word") >= 7)
    done = c.correct_words(n.select("query").unionByName(v.select(F.col("word").alias("query"))), v, None, meds)
    return done.select("query", "corrected", "flag", F.round("confidence", 6).alias("confidence"), F.round("distance", 6).alias("distance"))


def line_confidence(spark, sf_dir):
    """Parts' names, damaged word by word, corrected as lines."""
    v = _written_vocab(spark, sf_dir)
    line = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_id"), F.translate(F.lower("p_name"), NOISE_FROM, NOISE_TO).alias("text"))
    tokens = line.select(F.explode(F.split("text", r"\s+")).alias("query")).distinct()
    words = c.correct_words(tokens, v)
    return c.correct_lines(line, words)


def doc_decision(spark, sf_dir):
    """Decisions rolled up by brand: any rejected line rejects, any line to verify verifies."""
    d = line_confidence(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_id"), "p_brand"), "line_id")
    rank = F.when(F.col("decision") == "reject", 2).when(F.col("decision") == "verify", 1).otherwise(0)
    return d.groupBy("p_brand").agg(F.count("*").alias("n"), F.max(rank).alias("worst"), F.sum((rank == 0).cast("int")).alias("accepted")).select("p_brand", "n", "accepted", F.when(F.col("worst") == 2, "reject").when(F.col("worst") == 1, "verify").otherwise("accept").alias("decision"))


def scalar_fixes(spark, sf_dir):
    n = _noisy(_vocab(spark, sf_dir))
    up = F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)"))
    return n.select("word", "query", tx.fix_digraphs(F.col("query")).alias("digraphs"), tx.index_form(F.col("query")).alias("form"), tx.normalize_digits(F.upper("query")).alias("digits"), tx.preserve_case(F.upper("query"), F.col("word")).alias("upper_case"), tx.preserve_case(up, F.upper("word")).alias("title_case"))


def dose_normalize(spark, sf_dir):
    """Doses made of line items: quantities with look-alike letters for digits."""
    units = F.element_at(F.array(*map(F.lit, ["mg", "ml", "units", "g"])), F.col("l_linenumber") % 4 + 1)
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.translate(F.col("l_quantity").cast("int").cast("string"), "01", "Ol"), F.lit("5"), units).alias("token")).withColumn("d", tx.dose(F.col("token")))
    return d.select("l_orderkey", "l_linenumber", "token", "d.text", "d.value", "d.unit", F.col("d.changes").alias("changes"))


def lcs_accuracy(spark, sf_dir):
    """Successive turns of a conversation, aligned by their longest common subsequence of words."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.model_tokens(F.col("text")).alias("ws"))
    b = t.withColumn("before", F.lag("ws").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return b.select("conv_id", "turn", F.size("ws").alias("n"), F.size("before").alias("n_before"), lcs_length(F.col("ws"), F.col("before")).alias("lcs"))


UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
V = r"""vw AS (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part),
vd AS (SELECT unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)) AS word FROM documents),
v AS (SELECT DISTINCT word FROM (SELECT word FROM vw UNION ALL SELECT word FROM vd GROUP BY word HAVING count(*) >= 40) WHERE length(word) >= 3 AND regexp_matches(word, '^[a-z]+$')),
n AS (SELECT word, CASE ascii(substr(word, 2, 1)) % 3 WHEN 0 THEN translate(word, 'oilsebg', '011538g') WHEN 1 THEN replace(word, 'm', 'rn') ELSE substr(word, 1, 2) || substr(word, 4) END AS query FROM v)"""
_form = lambda x: f"translate(regexp_replace(lower({x}), '[^a-z0-9]', '', 'g'), '013568i', 'olesgbl')"
_dels = lambda f: f"list_distinct(list_transform(range(1, length({f}) + 1), lambda i: substr({f}, 1, i - 1) || substr({f}, i + 1, 999)))"
_shape = lambda q, qf, w, wf: f"(CASE WHEN substr({q},1,1) = substr({w},1,1) THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN right({q},1) = right({w},1) THEN 2 ELSE 0 END + CASE WHEN substr({qf},1,2) = substr({wf},1,2) THEN 2 ELSE 0 END + CASE WHEN right({qf},2) = right({wf},2) THEN 1 ELSE 0 END - 0.75::DOUBLE * abs(length({q}) - length({w})))"
_map = lambda costs: "MAP {" + ", ".join(f"'{k}': {x}::DOUBLE" for k, x in sorted(costs.items())) + "}"


def _wd(a, b, costs):
    x, y = f"string_split(lower({a}), '')", f"string_split(lower({b}), '')"
    return f"""list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda j: j::DOUBLE), list_transform({x}, lambda ch: [ascii(ch)::DOUBLE])), lambda row, ch:
      list_reduce(list_prepend([row[1] + 1], list_transform(range(1, length({b}) + 1), lambda j: [j::DOUBLE])), lambda done, jj: list_append(done, least(row[jj[1]::INT + 1] + 1, done[jj[1]::INT] + 1,
        row[jj[1]::INT] + CASE WHEN chr(ch[1]::INT) = {y}[jj[1]::INT] THEN 0::DOUBLE ELSE coalesce({_map(costs)}[least(chr(ch[1]::INT), {y}[jj[1]::INT]) || ',' || greatest(chr(ch[1]::INT), {y}[jj[1]::INT])], 1::DOUBLE) END))))[-1]"""


CAND = f"""qf AS (SELECT DISTINCT query, {_form('query')} AS qform FROM n), wf AS (SELECT word, {_form('word')} AS wform FROM v),
qk AS (SELECT query, qform, 'f' AS kind, qform AS key FROM qf UNION ALL SELECT query, qform, 'c', qform FROM qf UNION ALL SELECT query, qform, 'c', unnest({_dels('qform')}) FROM qf
  UNION ALL SELECT query, qform, 'p', substr(qform, 1, 2) || ':' || unnest(range(greatest(length(query) - 1, 1), length(query) + 2)) FROM qf UNION ALL SELECT query, qform, 's', right(qform, 2) || ':' || unnest(range(greatest(length(query) - 1, 1), length(query) + 2)) FROM qf),
wk AS (SELECT word, wform, 'f' AS kind, wform AS key FROM wf UNION ALL SELECT word, wform, 'c', unnest({_dels('wform')}) FROM wf UNION ALL SELECT word, wform, 'p', substr(wform, 1, 2) || ':' || length(word) FROM wf UNION ALL SELECT word, wform, 's', right(wform, 2) || ':' || length(word) FROM wf),
pr AS (SELECT DISTINCT query, qform, word, wform FROM qk JOIN wk USING (kind, key) WHERE key <> '' AND abs(length(query) - length(word)) <= 2),
cd AS (SELECT query, word, {_shape('query', 'qform', 'word', 'wform')} AS shape FROM pr QUALIFY row_number() OVER (PARTITION BY query ORDER BY shape DESC, word) <= 768)"""
RANK = f"""ds AS (SELECT query, word, {_wd('query', 'word', STATIC_COSTS)} AS distance, levenshtein(query, word) AS edit FROM cd),
ok AS (SELECT * FROM ds WHERE distance <= CASE WHEN length(query) <= 4 THEN greatest(0.35::DOUBLE * length(query), 1) ELSE greatest(0.45::DOUBLE * length(query), 2) END),
sg AS (SELECT *, CASE WHEN edit = 0 THEN 1::DOUBLE ELSE 1 - distance / edit END AS s1, greatest(0, 1 - abs(length(query) - length(word)) / greatest(length(query), 3)) AS s6, greatest(0, 1 - distance / greatest(length(query), 3)) AS s7 FROM ok),
sc AS (SELECT *, (s1 + s6 + s7) / 8 + CASE (s1 > 0.3)::INT + (s6 > 0.3)::INT + (s7 > 0.3)::INT WHEN 3 THEN 0.3::DOUBLE WHEN 2 THEN 0.1::DOUBLE ELSE 0 END AS score FROM sg),
rk AS (SELECT *, row_number() OVER w AS rank, round(score, 9) - coalesce(lead(round(score, 9)) OVER w, 0) AS margin0 FROM sc WINDOW w AS (PARTITION BY query ORDER BY round(score, 9) DESC, round(distance, 9), word)),
r5 AS (SELECT *, CASE WHEN rank = 5 THEN round(score, 9) ELSE margin0 END AS margin FROM rk WHERE rank <= 5), r1 AS (SELECT * FROM rk WHERE rank = 1)"""


def _gate(short, long, far, near):
    return f"""(NOT (regexp_matches(query, '[0-9]') AND regexp_matches(query, '[A-Za-z]'))) AND ((ratio >= CASE WHEN length(query) <= 4 THEN {short} ELSE {long} END AND NOT (edit <= 1 AND length(query) <> length(word)) AND NOT (edit <= 1 AND length(query) >= 8))
      OR ((edit >= {far} OR (edit >= {near} AND length(query) <= 5)) AND ratio >= 0.2))"""


SPL = r"SELECT unnest(regexp_split_to_array(text, '[ \n\t]+')) AS token FROM documents"
W = f"WITH {V}"
_digraphs = lambda x: f"replace(replace(replace(replace(replace(replace(replace({x}, 'rn', 'm'), 'cl', 'd'), 'vv', 'w'), 'nn', 'm'), 'ii', 'u'), 'li', 'h'), 'ri', 'n')"
_digits = lambda x: f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN contains('OoIl', substr({x}, i, 1)) AND (regexp_matches(CASE WHEN i > 1 THEN substr({x}, i - 1, 1) ELSE '' END, '[0-9OoIl]') OR regexp_matches(substr({x}, i + 1, 1), '[0-9OoIl]')) THEN translate(substr({x}, i, 1), 'OoIl', '0011') ELSE substr({x}, i, 1) END), '')"
SQL = {
    "deletion_index": f"{W}, f AS (SELECT {_form('word')} AS form FROM v) SELECT key, count(*) AS n FROM (SELECT unnest({_dels('form')}) AS key FROM f) GROUP BY key",
    "blocking_candidates": f"{W}, {CAND} SELECT query, count(*) AS n, max(shape) AS best_shape FROM cd GROUP BY query",
    "shape_score": f"{W} SELECT word, query, {_shape('query', _form('query'), 'word', _form('word'))} AS shape FROM n",
    "weighted_distances": f"{W} SELECT word, query, round({_wd('query', 'word', STATIC_COSTS)}, 6) AS static, round({_wd('query', 'word', CORE_COSTS)}, 6) AS core, levenshtein(query, word)::INT AS plain FROM n",
    "fuzzy_top1": f"{W}, {CAND}, {RANK} SELECT n.query, n.word, r1.word AS best, round(distance, 6) AS distance, r1.word = n.word AS right FROM n LEFT JOIN r1 ON r1.query = n.query",
    "fuzzy_signals_score": f"{W}, {CAND}, {RANK} SELECT query, word, rank::INT AS rank, round(distance, 6) AS distance, edit::INT AS edit, round(s1, 6) AS s1, round(s6, 6) AS s6, round(s7, 6) AS s7, round(score, 6) AS score, round(margin, 6) AS margin FROM r5",
    "evidence_gate": f"{W}, {CAND}, {RANK}, x AS (SELECT *, CASE WHEN edit > 0 THEN round(distance, 9) / edit ELSE 0 END AS ratio FROM r1) SELECT query, word, {_gate(0.35, 0.55, 3, 2)} AS keep, {_gate(0.6, 0.8, 6, 3)} AS keep_ocr FROM x",
    "guard_flags": rf"""SELECT flag, count(*) AS n FROM (SELECT CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '^[\d.,/\-:]+$') THEN 'number' WHEN regexp_matches(t, '(?i)^(dr|mr|mrs|ms|prof)\.?$') THEN 'title'
      WHEN regexp_matches(t, '(?i)^[\dOoIl]+(\.[\dOoIl]+)?\s*(mg|mcg|g|ml|units?|iu|%|mmol|meq)$') THEN 'dosage'
      WHEN length(t) <= 6 AND dg > 0 AND lt > 0 AND NOT regexp_matches(t, '^[a-zA-Z]{{2,}}\d[a-zA-Z]{{2,}}$') AND ((dg >= 2 AND regexp_matches(t, '^[0-9]')) OR (t = upper(t) AND length(t) <= 5) OR contains(t, '-')) THEN 'room_code'
      WHEN lt * 2 < length(t) THEN 'punctuation' END AS flag FROM (SELECT token AS t, len(regexp_extract_all(token, '[0-9]')) AS dg, len(regexp_extract_all(token, '[A-Za-z]')) AS lt FROM ({SPL}))) GROUP BY flag""",
    "peel_tokens": f"""WITH t AS ({SPL}), l AS (SELECT token, regexp_extract(token, '^[^a-zA-Z0-9]*') AS lead FROM t), r AS (SELECT lead, substr(token, length(lead) + 1) AS rest FROM l), x AS (SELECT lead, rest, regexp_extract(rest, '[^a-zA-Z0-9]*$') AS trail FROM r)
      SELECT lead, trail, count(*) AS n, sum(length(rest) - length(trail))::BIGINT AS core_chars FROM x GROUP BY lead, trail""",
    "scalar_fixes": f"{W} SELECT word, query, {_digraphs('query')} AS digraphs, {_form('query')} AS form, {_digits('upper(query)')} AS digits, CASE WHEN length(query) > 1 THEN upper(word) ELSE word END AS upper_case, upper(substr(word, 1, 1)) || lower(substr(word, 2)) AS title_case FROM n",
    "dose_normalize": rf"""WITH t AS (SELECT l_orderkey, l_linenumber, translate(l_quantity::INT::VARCHAR, '01', 'Ol') || '5' AS num, ['mg', 'ml', 'units', 'g'][l_linenumber % 4 + 1] AS unit FROM lineitem),
      f AS (SELECT *, {_digits('num')} AS fixed FROM t) SELECT l_orderkey, l_linenumber, num || unit AS token, fixed || unit AS text, fixed::DOUBLE AS value, unit, len(list_filter(range(1, length(num) + 1), lambda i: substr(num, i, 1) <> substr(fixed, i, 1)))::INT AS changes FROM f""",
    "lcs_accuracy": """WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1) AS ws FROM conversations),
      b AS (SELECT conv_id, turn, ws, lag(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t),
      i AS (SELECT *, list_transform(ws, lambda x: coalesce(list_position(before, x), 0)) AS ia, list_transform(before, lambda x: list_position(before, x)) AS ib FROM b WHERE before IS NOT NULL)
      SELECT conv_id, turn, len(ws)::INT AS n, len(before)::INT AS n_before, coalesce(list_reduce(list_prepend(list_transform(range(0, len(ib) + 1), lambda j: 0), list_transform(ia, lambda x: [x])), lambda row, x:
        list_reduce(list_prepend([0], list_transform(range(1, len(ib) + 1), lambda j: [j])), lambda done, j: list_append(done, CASE WHEN x[1] = ib[j[1]] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], done[j[1]]) END)))[-1], 0)::INT AS lcs FROM i""",
}
QUERIES = {
    "deletion_index": deletion_index, "blocking_candidates": blocking_candidates, "shape_score": shape_score, "weighted_distances": weighted_distances, "fuzzy_top1": fuzzy_top1, "fuzzy_signals_score": fuzzy_signals_score, "evidence_gate": evidence_gate,
    "guard_flags": guard_flags, "peel_tokens": peel_tokens, "correction_flags": correction_flags, "line_confidence": line_confidence, "doc_decision": doc_decision, "scalar_fixes": scalar_fixes, "dose_normalize": dose_normalize, "lcs_accuracy": lcs_accuracy,
}
