"""Queries over the language graph of `documents`, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import graph as g
from textloom.operators import roles, waves
from textloom.sources.storage import stored
from textloom.sources.tables import table


def _sents(spark, sf_dir):
    return g.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenize_sentences(spark, sf_dir):
    return _sents(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.size("ws")).alias("n_tokens"), F.sum(F.size(F.array_distinct("ws"))).alias("n_distinct"))


def reader_and_process_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.size(tx.reader_tokens(F.col("text"))).alias("n_reader"), F.size(tx.process_tokens(F.col("text"))).alias("n_process"))


def word_freq(spark, sf_dir):
    return g.tokens(_sents(spark, sf_dir)).groupBy("w").agg(F.count("*").alias("n"))


def _bigrams(spark, sf_dir):
    t = g.tokens(_sents(spark, sf_dir)).select("w")
    return t.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


def next_word_pairs(spark, sf_dir):
    return g.next_words(_sents(spark, sf_dir))


def prev_word_pairs(spark, sf_dir):
    """Each word's distinct predecessors and its commonest one."""
    nx = g.next_words(_sents(spark, sf_dir))
    return nx.groupBy(F.col("b").alias("w")).agg(F.count("*").alias("n_prev"), F.sum("n").alias("total"), F.max("n").alias("most"))


def trigrams(spark, sf_dir):
    return g.trigrams(_sents(spark, sf_dir))


def cooc_window3(spark, sf_dir):
    return g.near_words(_sents(spark, sf_dir))


def skipgram_weights(spark, sf_dir):
    return g.skip_words(_sents(spark, sf_dir)).select("a", "b", F.round("weight", 6).alias("weight"))


def word_positions_last50(spark, sf_dir):
    t = g.tokens(_sents(spark, sf_dir))
    last = t.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("doc_id"), F.desc("sid"), F.desc("pos")))).where(F.col("r") <= g.LAST)
    return last.groupBy("w").agg(F.count("*").alias("n"), F.round(F.sum((F.col("pos") / F.greatest(F.col("len") - 1, F.lit(1))).cast("decimal(18,12)")).cast("double") / F.count("*") + 1e-8, 6).alias("mean_position"))


def occurrence_gaps(spark, sf_dir):
    """Per word: first and last sentence, and the gaps between successive sentences that hold it."""
    n = g.numbered(_sents(spark, sf_dir))
    seen = n.select("ns", F.explode(F.array_distinct("ws")).alias("w"))
    # gaps between the distinct sentences add up to last - first: no window over a hot word's occurrences
    return seen.groupBy("w").agg(F.min("ns").alias("first_seen"), F.max("ns").alias("last_seen"), F.count("*").alias("n_sentences")).withColumn(
        "mean_gap", F.round((F.col("last_seen") - F.col("first_seen")) / F.nullif(F.col("n_sentences") - 1, F.lit(0)), 6)
    )


def neighborhood_volatility(spark, sf_dir):
    """Per word: how much its neighbours change from one occurrence in a sentence of a document to the next there."""
    # a document's sentences are dealt before each place is given its neighbours, so these aren't shuffled: the window finds its rows together
    s = _sents(spark, sf_dir).repartition("doc_id")
    around = F.transform("ws", lambda x, i: F.struct(x.alias("w"), i.alias("pos"), F.array_distinct(F.concat(F.slice("ws", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), F.slice("ws", i + 2, F.lit(3)))).alias("near")))
    o = s.select("doc_id", "sid", F.explode(around).alias("x")).select("doc_id", "sid", "x.*")
    before = F.lag("near").over(Window.partitionBy("doc_id", "w").orderBy("sid", "pos"))
    both = F.size(F.array_union("near", "before"))
    # in whole parts of which 27720 are one, as at most 12 words are on both sides: any order of the sum gives the same
    v = o.withColumn("before", before).where("before is not null").select("w", ((both - F.size(F.array_intersect("near", "before"))) * 27720 / both).cast("long").alias("v"))
    return v.groupBy("w").agg(F.count("*").alias("n"), F.round(F.sum("v") / (F.count("*") * 27720), 6).alias("volatility"))


def sentence_shape(spark, sf_dir):
    """Per word: mean length and diversity of its sentences."""
    s = _sents(spark, sf_dir).select(F.explode("ws").alias("w"), F.size("ws").alias("len"), F.size(F.array_distinct("ws")).alias("distinct"))
    return s.groupBy("w").agg(F.round(F.avg("len"), 6).alias("mean_length"), F.round(F.avg(F.col("distinct") / F.col("len")), 6).alias("mean_diversity"))


def decayed_bigrams(spark, sf_dir):
    return g.decayed(_sents(spark, sf_dir)).select("a", "b", F.round("weight", 6).alias("weight"))


def compact_topn(spark, sf_dir):
    return g.top(g.next_words(_sents(spark, sf_dir)), g.KEEP["next"])


def _freq_degree(spark, sf_dir):
    s = _sents(spark, sf_dir)
    return g.tokens(s).groupBy("w").agg(F.count("*").alias("n")), g.near_words(s).groupBy(F.col("a").alias("w")).agg(F.count("*").alias("degree"))


def inhibition_weights(spark, sf_dir):
    return g.inhibition(*_freq_degree(spark, sf_dir)).select("w", "n", "degree", F.round("weight", 6).alias("weight"))


def upper_median(spark, sf_dir):
    freq, degree = _freq_degree(spark, sf_dir)
    return g.upper_median(freq, "n").withColumnRenamed("n", "median_freq").crossJoin(g.upper_median(degree, "degree").withColumnRenamed("degree", "median_degree"))


def batch_resonance(spark, sf_dir):
    return g.batch_resonance(g.next_words(_sents(spark, sf_dir))).select("a", "b", F.round("resonance", 6).alias("resonance"))


def resonance_partners(spark, sf_dir):
    res = g.top(g.batch_resonance(g.next_words(_sents(spark, sf_dir))), 10, weight="resonance")
    return res.select("a", "b", "rank", F.round("resonance", 6).alias("resonance"), F.round(g.discount(F.col("resonance")), 6).alias("discount"))


def soft_next(spark, sf_dir):
    nx = g.top(g.next_words(_sents(spark, sf_dir)), g.KEEP["next"]).drop("rank")
    res = g.top(g.batch_resonance(nx), g.KEEP["resonance"], weight="resonance").drop("rank")
    soft = g.soft_next(nx, res)
    return soft.groupBy("a").agg(F.count("*").alias("n_next"), F.count(F.when(F.col("soft"), 1)).alias("n_soft"), F.round(F.sum("weight"), 4).alias("total"))


def bigram_coherence(spark, sf_dir):
    s = _sents(spark, sf_dir)
    c = g.coherence(s, g.ranked_next(g.next_words(s)), ["doc_id", "sid"])
    return c.select("doc_id", "sid", "steps", F.round("coherence", 6).alias("coherence"))


def turn_surprise(spark, sf_dir):
    """Conversations scored by the documents' graph."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ws = c.select("conv_id", "turn", tx.model_tokens(F.col("text")).alias("ws")).where(F.size("ws") >= 2)
    scored = g.coherence(ws, g.ranked_next(g.next_words(_sents(spark, sf_dir))), ["conv_id", "turn"])
    return scored.select("conv_id", "turn", "steps", F.round(1 - F.col("coherence"), 6).alias("surprise"))


def _pairs_next(sents):
    """The pairs of words of `pair_counts`, written once, and the adjacent ones among them."""
    pairs = stored(g.pair_counts(sents), "pairs")
    return pairs, stored(g.directed(pairs), "next")


def meaning_richness(spark, sf_dir):
    pairs, nx = _pairs_next(_sents(spark, sf_dir))
    return g.richness(pairs, g.batch_resonance(nx)).select("w", F.round("richness", 4).alias("richness"))


def graph_stats(spark, sf_dir):
    s = _sents(spark, sf_dir)
    pairs, nx = _pairs_next(s)
    return g.stats(g.tokens(s).groupBy("w").agg(F.count("*").alias("n")), _bigrams(spark, sf_dir), pairs, g.trigrams(s), g.batch_resonance(nx))


def expectation_vector(spark, sf_dir):
    """The eight numbers of what follows and precedes a word."""
    v = g.follow_sums(_sents(spark, sf_dir))
    e0, e2 = F.when(F.col("fn") > 0, F.col("ftop") / F.col("ftot")).otherwise(0.0), F.when(F.col("pn") > 0, F.col("ptop") / F.col("ptot")).otherwise(0.0)
    cols = [
        e0, F.least(F.col("fn") / 15, F.lit(1.0)), e2, F.least(F.col("pn") / 15, F.lit(1.0)), F.abs(e0 - e2), F.least((F.col("fn") + F.col("pn")) / 20, F.lit(1.0)),
        F.when((F.col("fn") > 0) & (F.col("pn") > 0), 1 - F.col("inter") / (F.col("fn") + F.col("pn") - F.col("inter"))).otherwise(0.0), F.when(F.col("fn") > 0, F.col("ftop3") / F.col("ftot")).otherwise(0.0),
    ]
    return v.select("w", *[F.round(c, 6).alias(f"e{i}") for i, c in enumerate(cols)])


def wave_activation(spark, sf_dir):
    """What each word excites in one step: how many nodes, how much energy, and the strongest."""
    graph = waves.build(_sents(spark, sf_dir))
    a = g.activated(graph.near, graph.next, graph.res, graph.skip(), graph.damping)
    return a.groupBy("w").agg(F.count("*").alias("n"), F.round(F.sum("energy"), 6).alias("energy"), F.round(F.max("energy"), 6).alias("strongest"))


def form_vectors(spark, sf_dir):
    w = g.tokens(_sents(spark, sf_dir)).select("w").where(F.col("w").rlike("^[a-z]+$")).distinct()
    return w.withColumn("v", g.form_vector(F.col("w"))).select("w", *[F.round(F.get("v", F.lit(i)), 6).alias(f"f{i}") for i in range(16)])


def roles_active_passive(spark, sf_dir):
    s = _sents(spark, sf_dir)
    return roles.extract(s, g.next_words(s), g.tokens(s).groupBy("w").agg(F.count("*").alias("n")))


SPACE = r"[ \t\n\x0B\f\r\x{00A0}\x{FEFF}\x{2028}\x{2029}]"
SENTS = rf"""sp AS (SELECT doc_id, regexp_split_to_array(text, '[.!?\n]+') AS a FROM documents),
s0 AS (SELECT doc_id, unnest(range(len(a)))::INT AS sid, unnest(a) AS s FROM sp),
s1 AS (SELECT doc_id, sid, regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g') AS s FROM s0),
s2 AS (SELECT doc_id, sid, list_filter(regexp_extract_all(lower(s), '[a-z0-9]+'), lambda x: length(x) > 1) AS ws FROM s1 WHERE length(s) > 5),
sents AS MATERIALIZED (SELECT * FROM s2 WHERE len(ws) >= 2),
tok AS (SELECT doc_id, sid, len(ws) AS len, unnest(range(len(ws)))::INT AS pos, unnest(ws) AS w FROM sents),
nx AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM sents) GROUP BY ALL),
wf AS (SELECT w, count(*) AS n FROM tok GROUP BY w)"""


def _at(d):
    return f"SELECT unnest(ws[:-{d + 1}]) AS a, unnest(ws[{d + 1}:]) AS b, {d} AS d FROM sents WHERE len(ws) > {d}"


NEAR = f"""pr AS ({' UNION ALL '.join(_at(d) for d in (1, 2, 3))}),
co AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr) GROUP BY ALL)"""
SKIP = f"""sk AS ({' UNION ALL '.join(_at(d) for d in range(2, 8))}),
snx AS (SELECT a, b, {' + '.join(f'count(*) FILTER (d = {d}) / {d}' for d in range(2, 8))} AS weight FROM sk GROUP BY ALL)"""


def _res(nx="nx"):
    return f"""bn AS (SELECT a, b AS t FROM {nx} QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) <= 5),
bp AS (SELECT b, a AS t FROM {nx} QUALIFY row_number() OVER (PARTITION BY b ORDER BY n DESC, a) <= 5),
rr AS (SELECT {nx}.b AS w, t, n FROM {nx} JOIN bn USING (a) WHERE {nx}.b <> t UNION ALL SELECT {nx}.a, t, n FROM {nx} JOIN bp USING (b) WHERE {nx}.a <> t),
res AS (SELECT a, b, sum(n) * 0.1::DOUBLE AS resonance FROM (SELECT w AS a, t AS b, n FROM rr UNION ALL SELECT t, w, n FROM rr) GROUP BY ALL)"""


NUM = "num AS (SELECT *, row_number() OVER (ORDER BY doc_id, sid) AS ns FROM sents)"
BG = "bg AS (SELECT substr(w, i::INT, 2) AS bigram, count(*) AS n FROM (SELECT w, unnest(range(1, length(w))) AS i FROM tok) GROUP BY ALL)"
EXPECTED = "ex AS (SELECT a, b, 0.4::DOUBLE * (n / sum(n) OVER w) + 0.6::DOUBLE * (1 - (row_number() OVER (PARTITION BY a ORDER BY n DESC, b) - 1) / count(*) OVER w) AS expected FROM nx WINDOW w AS (PARTITION BY a))"
DEG = "fd AS (SELECT w, wf.n, coalesce(degree, 0) AS degree FROM wf LEFT JOIN (SELECT a AS w, count(*) AS degree FROM co GROUP BY a) USING (w))"
W = f"WITH {SENTS}"
_median = lambda c, t: f"(SELECT min({c}) FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS k FROM {t}) WHERE i = k // 2)"

SQL = {
    "tokenize_sentences": f"{W} SELECT doc_id, count(*) AS n_sentences, sum(len(ws))::BIGINT AS n_tokens, sum(len(list_distinct(ws)))::BIGINT AS n_distinct FROM sents GROUP BY doc_id",
    "reader_and_process_tokens": r"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[a-z0-9]+)*'))::INT AS n_reader, len(regexp_extract_all(lower(text), '[a-z0-9.]+'))::INT AS n_process FROM documents",
    "word_freq": f"{W} SELECT w, n FROM wf",
    "char_bigrams": f"{W}, {BG} SELECT * FROM bg",
    "next_word_pairs": f"{W} SELECT * FROM nx",
    "prev_word_pairs": f"{W} SELECT b AS w, count(*) AS n_prev, sum(n)::BIGINT AS total, max(n) AS most FROM nx GROUP BY b",
    "trigrams": f"{W} SELECT a, b, c, count(*) AS n FROM (SELECT unnest(ws[:-3]) AS a, unnest(ws[2:-2]) AS b, unnest(ws[3:]) AS c FROM sents WHERE len(ws) > 2) GROUP BY ALL",
    "cooc_window3": f"{W}, {NEAR} SELECT * FROM co",
    "skipgram_weights": f"{W}, {SKIP} SELECT a, b, round(weight, 6) AS weight FROM snx",
    "word_positions_last50": f"{W} SELECT w, count(*) AS n, round(sum((pos / greatest(len - 1, 1))::DECIMAL(18,12))::DOUBLE / count(*) + 1e-8, 6) AS mean_position FROM (SELECT * FROM tok QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id DESC, sid DESC, pos DESC) <= 50) GROUP BY w",
    "occurrence_gaps": f"{W}, {NUM} SELECT w, min(ns) AS first_seen, max(ns) AS last_seen, count(*) AS n_sentences, round((max(ns) - min(ns)) / nullif(count(*) - 1, 0), 6) AS mean_gap FROM (SELECT ns, unnest(list_distinct(ws)) AS w FROM num) GROUP BY w",
    "neighborhood_volatility": f"""{W}, o AS (SELECT doc_id, sid, pos, w, list_distinct(s.ws[greatest(pos - 2, 1):pos] || s.ws[pos + 2:pos + 4]) AS near FROM tok JOIN sents s USING (doc_id, sid)),
      l AS (SELECT w, near, lag(near) OVER (PARTITION BY doc_id, w ORDER BY sid, pos) AS before FROM o)
      SELECT w, count(*) AS n, round(avg(1 - len(list_intersect(near, before)) / len(list_distinct(near || before))), 6) AS volatility FROM l WHERE before IS NOT NULL GROUP BY w""",
    "sentence_shape": f"{W} SELECT w, round(avg(len(ws)), 6) AS mean_length, round(avg(len(list_distinct(ws)) / len(ws)), 6) AS mean_diversity FROM (SELECT unnest(ws) AS w, ws FROM sents) GROUP BY w",
    "decayed_bigrams": f"""{W}, {NUM}, ev AS (SELECT (ns - 1) // 100 AS epoch, unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM num),
      k AS (SELECT a, b, epoch, count(*) AS k FROM ev GROUP BY ALL), x AS (SELECT a, b, sum(k * pow(0.97::DOUBLE, (SELECT max(ns) // 100 FROM num) - epoch)) AS weight FROM k GROUP BY ALL)
      SELECT a, b, round(weight, 6) AS weight FROM x WHERE weight >= 0.01""",
    "compact_topn": f"{W} SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b)::INT AS rank FROM nx QUALIFY rank <= 50",
    "inhibition_weights": f"{W}, {NEAR}, {DEG}, m AS (SELECT {_median('n', 'fd')} AS mn, {_median('degree', 'fd')} AS md) SELECT w, n, degree, round(least(greatest(0.5 / log2(n / greatest(mn, 1) + 2) + 0.5 / log2(degree / greatest(md, 1) + 2), 0.1), 1.0), 6) AS weight FROM fd, m",
    "upper_median": f"{W}, {NEAR}, dg AS (SELECT a, count(*) AS degree FROM co GROUP BY a) SELECT {_median('n', 'wf')} AS median_freq, {_median('degree', 'dg')} AS median_degree",
    "batch_resonance": f"{W}, {_res()} SELECT a, b, round(resonance, 6) AS resonance FROM res",
    "resonance_partners": f"{W}, {_res()} SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY resonance DESC, b)::INT AS rank, round(resonance, 6) AS resonance, round(least(0.6::DOUBLE + 0.08::DOUBLE * resonance, 0.95), 6) AS discount FROM res QUALIFY rank <= 10",
    "soft_next": f"""{W}, cx AS (SELECT a, b, n FROM nx QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) <= 50), {_res('cx')},
      r30 AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY a ORDER BY resonance DESC, b) <= 30),
      pt AS (SELECT a, b AS partner, least(0.6::DOUBLE + 0.08::DOUBLE * resonance, 0.95::DOUBLE) AS d, row_number() OVER (PARTITION BY a ORDER BY resonance DESC, b) AS rank FROM r30 WHERE b IN (SELECT a FROM cx) QUALIFY rank <= 5),
      ln AS (SELECT pt.a, cx.b, cx.n * d AS weight, rank FROM pt JOIN cx ON cx.a = pt.partner),
      fr AS (SELECT ln.a, ln.b, arg_min(weight, rank) AS weight FROM ln ANTI JOIN cx ON cx.a = ln.a AND cx.b = ln.b GROUP BY ALL),
      al AS (SELECT a, n::DOUBLE AS weight, false AS soft FROM cx UNION ALL SELECT a, weight, true FROM fr)
      SELECT a, count(*) AS n_next, count(*) FILTER (soft) AS n_soft, round(sum(weight), 4) AS total FROM al GROUP BY a""",
    "bigram_coherence": f"{W}, {EXPECTED}, st AS (SELECT doc_id, sid, unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM sents) SELECT doc_id, sid, count(*) AS steps, round(avg(coalesce(expected, 0)), 6) AS coherence FROM st LEFT JOIN ex USING (a, b) GROUP BY ALL",
    "turn_surprise": f"""{W}, {EXPECTED}, cw AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1) AS ws FROM conversations),
      st AS (SELECT conv_id, turn, unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM cw WHERE len(ws) >= 2) SELECT conv_id, turn, count(*) AS steps, round(1 - avg(coalesce(expected, 0)), 6) AS surprise FROM st LEFT JOIN ex USING (a, b) GROUP BY ALL""",
    "meaning_richness": f"""{W}, {NEAR}, {SKIP}, {_res()} SELECT w, round(sum(x), 4) AS richness FROM (SELECT a AS w, count(*) * 1.0::DOUBLE AS x FROM nx GROUP BY a UNION ALL SELECT b, count(*) * 1.0::DOUBLE FROM nx GROUP BY b
      UNION ALL SELECT b, count(*) * 0.5::DOUBLE FROM snx GROUP BY b UNION ALL SELECT a, count(*) * 0.3::DOUBLE FROM co GROUP BY a UNION ALL SELECT a, count(*) * 0.5::DOUBLE FROM res GROUP BY a) GROUP BY w""",
    "graph_stats": f"""{W}, {NEAR}, {SKIP}, {_res()}, {BG} SELECT 'vocabulary' AS name, count(*) AS value FROM wf UNION ALL SELECT 'mature', count(*) FROM wf WHERE n >= 10 UNION ALL SELECT 'bigrams', count(*) FROM bg UNION ALL SELECT 'transitions', count(*) FROM nx
      UNION ALL SELECT 'cooccurrences', count(*) FROM co UNION ALL SELECT 'trajectories', count(*) FROM (SELECT DISTINCT a, b, c FROM (SELECT unnest(ws[:-3]) AS a, unnest(ws[2:-2]) AS b, unnest(ws[3:]) AS c FROM sents WHERE len(ws) > 2))
      UNION ALL SELECT 'skip_grams', count(*) FROM snx UNION ALL SELECT 'resonance_pairs', count(*) // 2 FROM res""",
    "expectation_vector": f"""{W}, f AS (SELECT a AS w, sum(n) AS ftot, count(*) AS fn, max(n) AS ftop, sum(n) FILTER (rank <= 3) AS ftop3 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM nx) GROUP BY a),
      p AS (SELECT b AS w, sum(n) AS ptot, count(*) AS pn, max(n) AS ptop FROM nx GROUP BY b), i AS (SELECT x.a AS w, count(*) AS inter FROM nx x JOIN nx y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
      v AS (SELECT w, coalesce(fn, 0) AS fn, coalesce(pn, 0) AS pn, coalesce(inter, 0) AS inter, coalesce(ftop / ftot, 0) AS e0, coalesce(ptop / ptot, 0) AS e2, coalesce(ftop3 / ftot, 0) AS e7 FROM f FULL JOIN p USING (w) LEFT JOIN i USING (w))
      SELECT w, round(e0, 6) AS e0, round(least(fn / 15, 1), 6) AS e1, round(e2, 6) AS e2, round(least(pn / 15, 1), 6) AS e3, round(abs(e0 - e2), 6) AS e4, round(least((fn + pn) / 20, 1), 6) AS e5,
        round(CASE WHEN fn > 0 AND pn > 0 THEN 1 - inter / (fn + pn - inter) ELSE 0 END, 6) AS e6, round(e7, 6) AS e7 FROM v""",
    "wave_activation": f"""{W}, {NEAR}, {SKIP}, {_res()}, {DEG}, m AS (SELECT {_median('n', 'fd')} AS mn, {_median('degree', 'fd')} AS md),
      dm AS (SELECT w, least(greatest(0.5 / log2(n / greatest(mn, 1) + 2) + 0.5 / log2(degree / greatest(md, 1) + 2), 0.1), 1.0) AS damp FROM fd, m),
      e AS ({' UNION ALL '.join(f"SELECT a, b, 0.3::DOUBLE * {x}::DOUBLE * {c} / sum({c}) OVER (PARTITION BY a) AS e FROM (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY a ORDER BY {c} DESC, b) <= 15)" for t, c, x in (('co', 'n', 0.30), ('nx', 'n', 0.25), ('snx', 'weight', 0.20)))}
        UNION ALL SELECT a, b, 0.3::DOUBLE * 0.25::DOUBLE * least(0.6::DOUBLE + 0.08::DOUBLE * resonance, 0.95::DOUBLE) FROM res QUALIFY row_number() OVER (PARTITION BY a ORDER BY resonance DESC, b) <= 15),
      x AS (SELECT a AS w, b AS node, sum(e * damp) AS energy FROM e JOIN dm ON dm.w = b GROUP BY ALL) SELECT w, count(*) AS n, round(sum(energy), 6) AS energy, round(max(energy), 6) AS strongest FROM x GROUP BY w""",
    "roles_active_passive": f"""{W}, s AS (SELECT doc_id, sid, ws, len(ws) AS len, list_filter(list_transform(range(len(ws)), lambda i: CASE WHEN ws[i + 1] IN {roles.AUXILIARIES} THEN i + nullif(coalesce(list_position(ws[i + 2:i + 5], 'by'), 0), 0) END), lambda x: x IS NOT NULL)[1] AS by_at,
        list_filter(list_transform(range(len(ws)), lambda i: {{'i': i, 'w': ws[i + 1]}}), lambda x: x.w NOT IN {roles.FUNCTION_WORDS}) AS c FROM sents),
      w0 AS (SELECT doc_id, sid, len, by_at, len(c) AS n_content, unnest(range(len(c))) AS k, unnest(c) AS x FROM s), w AS (SELECT doc_id, sid, len, by_at, n_content, k, x.i AS i, x.w AS w FROM w0),
      ex AS (SELECT x.doc_id, x.sid, x.i, y.i AS j, least(n, 5) * 2.0::DOUBLE AS e FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.sid = y.sid AND x.i < y.i JOIN nx ON nx.a = x.w AND nx.b = y.w),
      ft AS (SELECT doc_id, sid, i, sum(e) AS fit FROM (SELECT doc_id, sid, i, e FROM ex UNION ALL SELECT doc_id, sid, j, e FROM ex) GROUP BY ALL),
      ff AS (SELECT a AS w, count(*) AS f FROM nx GROUP BY a), pp AS (SELECT b AS w, count(*) AS p FROM nx GROUP BY b), xx AS (SELECT u.a AS w, count(*) AS x FROM nx u JOIN nx v ON u.a = v.b AND u.b = v.a GROUP BY u.a),
      ay AS (SELECT w, 1 - coalesce(x, 0) / (coalesce(f, 0) + coalesce(p, 0) - coalesce(x, 0)) AS asym FROM ff FULL JOIN pp USING (w) LEFT JOIN xx USING (w)),
      kn AS (SELECT w.*, greatest(max(coalesce(wf.n, 0)) OVER (PARTITION BY doc_id, sid), 1) AS most, coalesce(wf.n, 0) AS freq, coalesce(asym, 0) AS asym, coalesce(fit, 0) AS fit FROM w LEFT JOIN wf USING (w) LEFT JOIN ay USING (w) LEFT JOIN ft USING (doc_id, sid, i)),
      bs AS (SELECT doc_id, sid, k AS "at" FROM kn WHERE n_content <= 2 OR by_at IS NOT NULL OR (k > 0 AND k < n_content - 1) QUALIFY row_number() OVER (PARTITION BY doc_id, sid ORDER BY
        round(10.0::DOUBLE * asym + fit + CASE WHEN k > 0 AND k < n_content - 1 THEN 3.0::DOUBLE ELSE 0 END - 4.0::DOUBLE * freq / most - CASE WHEN i = 0 THEN 5.0::DOUBLE ELSE 0 END - CASE WHEN i = len - 1 THEN 3.0::DOUBLE ELSE 0 END, 9) DESC, k) = 1),
      z AS (SELECT s.*, "at", c["at" + 1].w AS action, CASE WHEN "at" > 0 THEN c[1].w END AS first FROM s LEFT JOIN bs USING (doc_id, sid))
      SELECT doc_id, sid, by_at IS NOT NULL AS passive, CASE WHEN len(c) > 1 THEN CASE WHEN by_at IS NOT NULL THEN list_filter(c, lambda x: x.i > by_at AND x.w <> action)[1].w ELSE first END END AS agent, action,
        CASE WHEN len(c) > 1 THEN CASE WHEN by_at IS NOT NULL THEN first ELSE c["at" + 2].w END END AS patient FROM z""",
}
QUERIES = {
    "tokenize_sentences": tokenize_sentences, "reader_and_process_tokens": reader_and_process_tokens, "word_freq": word_freq, "char_bigrams": _bigrams, "next_word_pairs": next_word_pairs, "prev_word_pairs": prev_word_pairs, "trigrams": trigrams,
    "cooc_window3": cooc_window3, "skipgram_weights": skipgram_weights, "word_positions_last50": word_positions_last50, "occurrence_gaps": occurrence_gaps, "neighborhood_volatility": neighborhood_volatility, "sentence_shape": sentence_shape,
    "decayed_bigrams": decayed_bigrams, "compact_topn": compact_topn, "inhibition_weights": inhibition_weights, "upper_median": upper_median, "batch_resonance": batch_resonance, "resonance_partners": resonance_partners, "soft_next": soft_next,
    "bigram_coherence": bigram_coherence, "turn_surprise": turn_surprise, "meaning_richness": meaning_richness, "graph_stats": graph_stats, "expectation_vector": expectation_vector, "wave_activation": wave_activation, "form_vectors": form_vectors, "roles_active_passive": roles_active_passive,
}
