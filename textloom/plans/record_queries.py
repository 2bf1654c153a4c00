"""Queries of safety checks, learning, redaction, layout, ingest and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions.distance import STATIC_COSTS, cost_map
from textloom.operators import layout, learn, privacy, safety
from textloom.plans.correct_queries import CAND, RANK, V, _noisy, _ranked, _vocab
from textloom.sources import ingest
from textloom.sources.tables import table
from textloom.streaming import events as ev

LABS = sorted(safety.RANGES)


def _values(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return e.select("event_id", F.element_at(F.array(*map(F.lit, LABS)), (F.col("event_id") % len(LABS) + 1).cast("int")).alias("name"), F.floor(F.col("value") * 10).cast("string").alias("raw"))


def lab_range_flags(spark, sf_dir):
    f = safety.check_ranges(_values(spark, sf_dir), safety.ranges(spark))
    return f.select("event_id", "name", "raw", "value", "status", "severity")


def decimal_alternatives(spark, sf_dir):
    f = safety.check_ranges(_values(spark, sf_dir), safety.ranges(spark)).where("status = 'OUT_OF_RANGE'")
    return f.select("event_id", F.size("alternatives").alias("n"), F.round(F.array_min("alternatives"), 9).alias("least"), F.round(F.array_max("alternatives"), 9).alias("most"))


def lookback_lab(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")
    return safety.nearest_before(t, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_returnflag") == "R", F.col("l_partkey")).select("l_orderkey", "l_linenumber", F.col("before").alias("nearest"))


def dose_plausibility(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 7 == 0, "insulin").otherwise("other").alias("name"), (F.floor("l_extendedprice") / 10).alias("v"), F.when(F.col("l_linenumber") % 2 == 0, "mg").otherwise("units").alias("unit"))
    return t.groupBy("name", "unit").agg(F.count("*").alias("n"), F.count(F.when(safety.implausible_dose(F.col("name"), F.col("v"), F.col("unit")), 1)).alias("implausible"))


def med_ambiguity(spark, sf_dir):
    _, r = _ranked(spark, sf_dir, 2)
    meds = _vocab(spark, sf_dir).where(F.length("word") >= 5)
    return safety.ambiguous_names(r, meds).select("query", "first", "second", F.round("gap", 6).alias("gap"))


def confusion_counts(spark, sf_dir):
    return learn.substitutions(_noisy(_vocab(spark, sf_dir)), "query", "word")


def adaptive_cost(spark, sf_dir):
    n = confusion_counts(spark, sf_dir)
    total = n.agg(F.sum("n").alias("total"))
    base = F.coalesce(F.try_element_at(cost_map(STATIC_COSTS), F.col("pair")), F.lit(1.0))
    return n.crossJoin(F.broadcast(total)).select("pair", "n", F.round(learn.adapted_cost(base, F.col("n"), F.col("total")), 6).alias("cost"))


def top_confusions(spark, sf_dir):
    return confusion_counts(spark, sf_dir).orderBy(F.desc("n"), "pair").limit(10)


def ward_frequency_boost(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where(F.length("word") > 1)
    return w.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", F.round(learn.frequency_boost(F.col("n")), 6).alias("boost"))


def learned_words(spark, sf_dir):
    """Words confirmed twice or more in conversations that the vocabulary hasn't."""
    from textloom.functions import text as tx

    w = table(spark, sf_dir, "conversations").select(F.explode(tx.model_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")
    return w.join(_vocab(spark, sf_dir), "word", "left_anti")


def _rows(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    d = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return c.join(F.broadcast(d), c.c_nationkey == d.n_nationkey).select("c_custkey", F.col("c_mktsegment").alias("segment"), "nation", "region")


COLUMNS = ["segment", "nation", "region"]


def context_chains(spark, sf_dir):
    return learn.chains(_rows(spark, sf_dir), COLUMNS)


def chain_predict_topk(spark, sf_dir):
    return learn.predicted(context_chains(spark, sf_dir))


def chain_boost(spark, sf_dir):
    """How much the segments speak for a nation's name."""
    c = context_chains(spark, sf_dir).where("ctx_col = 'segment' and tgt_col = 'nation'")
    return c.groupBy("token").agg(F.round(F.sum(learn.CHAIN * F.log(1 + F.col("n"))), 6).alias("boost"))


def clinical_weight_map(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.element_at(F.array(*map(F.lit, ["Medication list", "Diagnosis", "Room", "Patient name", "remarks", "Lab result"])), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("name"), "o_totalprice")
    return o.groupBy("name").agg(F.count("*").alias("n")).select("name", "n", learn.column_weight(F.col("name")).alias("weight"))


def census_summary(spark, sf_dir):
    d = F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "O", "verify").otherwise("reject")
    o = table(spark, sf_dir, "orders").select("o_orderpriority", d.alias("decision"))
    n = lambda x: F.count(F.when(F.col("decision") == x, 1)).alias(x)
    return o.rollup("o_orderpriority").agg(F.count("*").alias("total"), n("accept"), n("verify"), n("reject"))


def metrics_by_column(spark, sf_dir):
    """Accuracy before and after by column, and over all of them, in one pass."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("column"), (F.col("l_quantity") > 25).alias("raw"), ((F.col("l_quantity") > 25) | (F.col("l_discount") > 0.05)).alias("fixed"))
    return l.rollup("column").agg(F.count("*").alias("n"), F.count(F.when(F.col("raw"), 1)).alias("raw_right"), F.count(F.when(F.col("fixed"), 1)).alias("fixed_right"), F.count(F.when(F.col("fixed") & ~F.col("raw"), 1)).alias("fixes"))


def trend_last10(spark, sf_dir):
    return ev.last_of(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(20,6)")).cast("double"), 4).alias("total"))


def feedback_windows50(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).alias("window"), "event_type")
    return e.groupBy("window").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types"), F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"))


def pii_shield_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *privacy.counts(F.col("text")))


def pii_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(privacy.redact(F.col("text"))).alias("redacted"))


def pii_mapping(spark, sf_dir):
    return privacy.findings(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def _points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") / 10).alias("x"), "l_returnflag")


def row_islands(spark, sf_dir):
    i = layout.islands(_points(spark, sf_dir), "l_suppkey", "x", layout.ROW_GAP, ("l_orderkey", "l_linenumber"))
    return i.groupBy("l_suppkey", "island").agg(F.count("*").alias("n"), F.min("x").alias("from"), F.max("x").alias("to"))


def column_clusters(spark, sf_dir):
    return layout.columns(_points(spark, sf_dir), "l_suppkey", "x")


def column_anchor_words(spark, sf_dir):
    p = _points(spark, sf_dir)
    j = layout.in_columns(p, layout.columns(p, "l_suppkey", "x"), "l_suppkey", "x")
    return layout.anchors(j, "l_suppkey", "column", "l_returnflag")


PREFIXES, SUFFIXES = ("re", "un", "pre", "post", "anti", "sub", "inter"), ("ing", "ed", "er", "al", "ic", "itis", "osis")


def vocab_expansion(spark, sf_dir):
    """The parts' words with prefixes, suffixes and both: a row each, exploded from the word."""
    w = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("root")).distinct()
    forms = [F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in (p, F.col("root"), s)]) for p in ("", *PREFIXES) for s in ("", *SUFFIXES)]
    return w.select(F.explode(F.array(*forms)).alias("word")).where(F.col("word").rlike("^[a-z]{4,28}$")).distinct()


def seed_export_distinct(spark, sf_dir):
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    fields = c.select(F.explode(F.array("c_name", "c_mktsegment")).alias("value")).unionByName(p.select(F.explode(F.array("p_name", "p_brand", "p_type")).alias("value")))
    return fields.select(F.trim("value").alias("value")).where(F.length("value") > 1).distinct()


def train_val_split(spark, sf_dir):
    """Nine to one by a hash of the document's id."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 10 == 0).alias("val"))
    return d.select("doc_id", F.when(F.col("val"), "val").otherwise("train").alias("split"))


def char_dictionary(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return c.groupBy("ch").agg(F.count("*").alias("n"))


def text_lines(spark, sf_dir):
    return ingest.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))


def magic_types(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[^?#]*", 0).alias("path"), "html")
    return p.select("page_id", ingest.type_of(F.col("path"), F.col("html").cast("binary")).alias("type"))


def event_props(spark, sf_dir):
    """JSON properties of events, parsed and counted by key."""
    e = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return e.groupBy("key").agg(F.count("*").alias("n"))


def streaming_windows(spark, sf_dir):
    w = ev.tumbling(ev.stream_of(spark, sf_dir, "events"))
    return w.select("begin", "event_type", "n", F.round(F.col("total").cast("double"), 4).alias("total"))


def streaming_learn(spark, sf_dir):
    """Word counts learned from the documents as a stream equal those of one batch."""
    from textloom.functions import text as tx

    words = ev.stream_of(spark, sf_dir, "documents").select(F.explode(tx.model_tokens(F.col("text"))).alias("w"))
    return ev.summed(words, ["w"], {"n": "1"})


def sliding_windows(spark, sf_dir):
    return ev.sliding(table(spark, sf_dir, "events"))


def session_windows(spark, sf_dir):
    return ev.sessions(table(spark, sf_dir, "events"))


def character_alignment(spark, sf_dir):
    """Which letters of damaged words stand for which, by the cheapest alignment."""
    from textloom.operators import align

    x = _noisy(_vocab(spark, sf_dir)).select(F.explode(align.aligned_characters(F.col("query"), F.col("word"))).alias("x"))
    return x.groupBy("x.kind", "x.a", "x.b").agg(F.count("*").alias("n"))


def feedback_evaluation(spark, sf_dir):
    """Each turn of a conversation held against the one before, word by word."""
    from textloom.operators import align

    # dealt into a stated number of parts: the texts are small and their alignments dear, so parts aren't to be put together by their size
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").repartition(parts, "conv_id")
    b = t.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return align.evaluated(b.withColumn("key", F.struct("conv_id", "turn")), "text", "before", "key").select("key.conv_id", "key.turn", "total", "correct", "substitutions", "deleted", "inserted")


W = f"WITH {V}"
_labs = "[" + ", ".join(f"'{x}'" for x in LABS) + "]"
VALS = f"""vals AS (SELECT event_id, {_labs}[event_id % {len(LABS)} + 1] AS name, floor(value * 10)::BIGINT::VARCHAR AS raw FROM events),
rg(name, least, most) AS (VALUES {', '.join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in sorted(safety.RANGES.items()))}),
st AS (SELECT *, raw::DOUBLE AS value, list_filter(list_transform(range(1, length(raw)), lambda i: (substr(raw, 1, i) || '.' || substr(raw, i + 1))::DOUBLE), lambda v: v >= least AND v <= most) AS alt FROM vals JOIN rg USING (name))"""
CONF = f"""{W}, cc AS (SELECT least(x, y) || ',' || greatest(x, y) AS pair, count(*) AS n FROM (SELECT unnest(string_split(query, '')) AS x, unnest(string_split(word, '')) AS y FROM n WHERE length(query) = length(word)) WHERE x <> y GROUP BY 1)"""
ROWS = "rw AS (SELECT lower(c_mktsegment) AS segment, lower(n_name) AS nation, lower(r_name) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
CH = f"""WITH {ROWS}, pr AS ({' UNION ALL '.join(f"SELECT '{a}' AS ctx_col, {a} AS ctx_val, '{b}' AS tgt_col, {b} AS v FROM rw" for a in COLUMNS for b in COLUMNS if a != b)}),
ch AS (SELECT ctx_col, ctx_val, tgt_col, token, count(*) AS n FROM (SELECT ctx_col, ctx_val, tgt_col, unnest([v] || list_filter(string_split(v, ' '), lambda x: length(x) > 1)) AS token FROM pr) GROUP BY ALL)"""
PTS = "WITH p AS (SELECT l_suppkey, l_orderkey, l_linenumber, floor(l_extendedprice / 10)::BIGINT AS x, l_returnflag FROM lineitem)"


def _isl(gap, order=""):
    w = f"OVER (PARTITION BY l_suppkey ORDER BY x{order})"
    return f"i0 AS (SELECT *, CASE WHEN x - lag(x) {w} <= {gap} THEN 0 ELSE 1 END AS new FROM p), i AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY x{order} ROWS UNBOUNDED PRECEDING) AS island FROM i0)"


COLS = f"""{_isl(layout.COLUMN_GAP, ', l_orderkey, l_linenumber')}, c AS (SELECT l_suppkey, island, min(x) AS "from", max(x) AS "to", count(*) AS n FROM i GROUP BY ALL HAVING count(*) >= 3), cl AS (SELECT l_suppkey, "from", "to", n, row_number() OVER (PARTITION BY l_suppkey ORDER BY "from")::INT AS "column" FROM c)"""
_re = lambda p: p.replace("'", "''")
_cnt = lambda p: f"len(regexp_extract_all(text, '{_re(p)}'))::INT"
_redact = "text"
for _p, _r in ((privacy.CIVIL, "[[CID]]"), (r"(?i)\b(MRN|File|ID)([:\s#]*)\d{6,8}\b", r"\1\2[[MRN]]"), (privacy.BIRTH, "[[DOB]]"), (privacy.PHONE, "[[PHN]]"), (privacy.EMAIL, "[[EML]]")):
    _redact = f"regexp_replace({_redact}, '{_re(_p)}', '{_r}', 'g')"
_left = f"regexp_replace(regexp_replace(regexp_replace(text, '{_re(privacy.CIVIL)}', '[[CID]]', 'g'), '{_re(privacy.RECORD)}', '[[MRN]]', 'g'), '{_re(privacy.BIRTH)}', '[[DOB]]', 'g')"
_all = " || ".join(f"list_transform(regexp_extract_all({t}, '{_re(p)}', {g}), lambda x: {{'t': '{k}', 'x': x}})" for k, t, p, g in (("CID", "text", privacy.CIVIL, 0), ("MRN", "text", privacy.RECORD, 1), ("DOB", "text", privacy.BIRTH, 0), ("PHN", _left, privacy.PHONE, 0)))
_weight = " ".join(f"WHEN contains(lower(name), '{p}') THEN {w}::DOUBLE" for p, w in learn.COLUMN_WEIGHTS)
_base = "CASE pair " + " ".join(f"WHEN '{k}' THEN {x}::DOUBLE" for k, x in STATIC_COSTS.items()) + " ELSE 1 END"
_forms = ", ".join(f"'{p}' || root || '{s}'" for p in ("", *PREFIXES) for s in ("", *SUFFIXES))
_ext = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ingest.EXTENSIONS.items())
SQL = {
    "lab_range_flags": f"WITH {VALS} SELECT event_id, name, raw, value, CASE WHEN value >= least AND value <= most THEN 'in_range' ELSE 'OUT_OF_RANGE' END AS status, CASE WHEN value >= least AND value <= most THEN NULL WHEN len(alt) > 0 THEN 'warning' ELSE 'error' END AS severity FROM st",
    "decimal_alternatives": f"WITH {VALS} SELECT event_id, len(alt)::INT AS n, round(list_min(alt), 9) AS least, round(list_max(alt), 9) AS most FROM st WHERE NOT (value >= least AND value <= most)",
    "lookback_lab": "SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_returnflag = 'R' THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS nearest FROM lineitem",
    "dose_plausibility": "WITH t AS (SELECT CASE WHEN l_partkey % 7 = 0 THEN 'insulin' ELSE 'other' END AS name, floor(l_extendedprice) / 10 AS v, CASE WHEN l_linenumber % 2 = 0 THEN 'mg' ELSE 'units' END AS unit FROM lineitem) SELECT name, unit, count(*) AS n, count(*) FILTER ((unit = 'mg' AND v > 5000) OR (name = 'insulin' AND v > 200)) AS implausible FROM t GROUP BY ALL",
    "med_ambiguity": f"{W}, {CAND}, {RANK}, tw AS (SELECT * FROM rk WHERE rank <= 2 AND length(word) >= 5) SELECT query, arg_min(word, rank) AS first, arg_max(word, rank) AS second, round(arg_max(distance, rank) - arg_min(distance, rank), 6) AS gap FROM tw GROUP BY query HAVING count(*) = 2 AND round(arg_max(distance, rank) - arg_min(distance, rank), 9) < 1.5",
    "confusion_counts": f"{CONF} SELECT * FROM cc",
    "adaptive_cost": f"{CONF}, t AS (SELECT sum(n) AS total FROM cc), b AS (SELECT pair, n, total, {_base} AS base, least(total / 50, 1) AS share, greatest(0.05::DOUBLE, 1 - 5 * n / total) AS seen FROM cc, t) SELECT pair, n, round(CASE WHEN total < 5 THEN base ELSE base * (1 - share) + seen * share END, 6) AS cost FROM b",
    "top_confusions": f"{CONF} SELECT * FROM cc ORDER BY n DESC, pair LIMIT 10",
    "ward_frequency_boost": "SELECT word, count(*) AS n, round(ln(1 + count(*)) / ln(101), 6) AS boost FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE length(word) > 1 GROUP BY word",
    "learned_words": f"{W}, c AS (SELECT unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)) AS word FROM conversations) SELECT word, count(*) AS n FROM c WHERE word NOT IN (SELECT word FROM v) GROUP BY word HAVING count(*) >= 2",
    "context_chains": f"{CH} SELECT * FROM ch",
    "chain_predict_topk": f"{CH} SELECT *, row_number() OVER (PARTITION BY ctx_col, ctx_val, tgt_col ORDER BY n DESC, token)::INT AS rank FROM ch QUALIFY rank <= 5",
    "chain_boost": f"{CH} SELECT token, round(sum(0.3::DOUBLE * ln(1 + n)), 6) AS boost FROM ch WHERE ctx_col = 'segment' AND tgt_col = 'nation' GROUP BY token",
    "clinical_weight_map": f"WITH o AS (SELECT ['Medication list', 'Diagnosis', 'Room', 'Patient name', 'remarks', 'Lab result'][o_orderkey % 6 + 1] AS name FROM orders) SELECT name, count(*) AS n, CASE {_weight} ELSE 1 END AS weight FROM o GROUP BY name",
    "census_summary": "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS accept, count(*) FILTER (o_orderstatus = 'O') AS verify, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS reject FROM orders GROUP BY ROLLUP (o_orderpriority)",
    "metrics_by_column": """SELECT l_returnflag AS "column", count(*) AS n, count(*) FILTER (l_quantity > 25) AS raw_right, count(*) FILTER (l_quantity > 25 OR l_discount > 0.05) AS fixed_right, count(*) FILTER (l_quantity <= 25 AND l_discount > 0.05) AS fixes FROM lineitem GROUP BY ROLLUP (l_returnflag)""",
    "trend_last10": "SELECT user_id, count(*) AS n, round(sum(value::DECIMAL(20,6))::DOUBLE, 4) AS total FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10) GROUP BY user_id",
    "feedback_windows50": """SELECT event_id // 50 AS "window", count(*) AS n, count(DISTINCT event_type) AS types, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1""",
    "pii_shield_counts": f"SELECT doc_id, {_cnt(privacy.CIVIL)} AS civil, {_cnt(privacy.RECORD)} AS record, {_cnt(privacy.BIRTH)} AS birth, {_cnt(privacy.PHONE)} AS phone, {_cnt(privacy.EMAIL)} AS email FROM documents",
    "pii_redact": f"SELECT doc_id, md5({_redact}) AS redacted FROM documents",
    "pii_mapping": f"WITH f AS (SELECT doc_id, {_all} AS l FROM documents), e AS (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS z FROM f) SELECT doc_id, z.t AS type, '[[' || z.t || '_' || lpad(n::VARCHAR, 4, '0') || ']]' AS token, sha256(z.x) AS hash FROM e",
    "row_islands": f"""{PTS}, {_isl(layout.ROW_GAP, ', l_orderkey, l_linenumber')} SELECT l_suppkey, island::BIGINT AS island, count(*) AS n, min(x) AS "from", max(x) AS "to" FROM i GROUP BY ALL""",
    "column_clusters": f"{PTS}, {COLS} SELECT * FROM cl",
    "column_anchor_words": f"""{PTS}, {COLS} SELECT p.l_suppkey, "column", l_returnflag, count(*) AS n FROM p JOIN cl ON p.l_suppkey = cl.l_suppkey AND x BETWEEN "from" AND "to" GROUP BY ALL HAVING count(*) >= 2""",
    "vocab_expansion": f"WITH r AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS root FROM part) SELECT DISTINCT word FROM (SELECT unnest([{_forms}]) AS word FROM r) WHERE regexp_matches(word, '^[a-z]{{4,28}}$')",
    "seed_export_distinct": "SELECT DISTINCT trim(value) AS value FROM (SELECT unnest([c_name, c_mktsegment]) AS value FROM customer UNION ALL SELECT unnest([p_name, p_brand, p_type]) FROM part) WHERE length(trim(value)) > 1",
    "train_val_split": "SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM documents",
    "char_dictionary": "SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch",
    "text_lines": r"SELECT doc_id, count(*) AS n_lines, max(length(line))::INT AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id",
    "magic_types": rf"SELECT page_id, coalesce(CASE lower(regexp_extract(regexp_extract(url, '^[^?#]*'), '\.([A-Za-z0-9]+)$', 1)) {_ext} END, CASE " + " ".join(f"WHEN starts_with(hex(encode(substr(html, 1, 8))), '{m}') THEN '{k}'" for m, k in ingest.MAGIC) + " ELSE 'text' END) AS type FROM pages",
    "event_props": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "streaming_windows": "SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n, round(sum(value::DECIMAL(20,6))::DOUBLE, 4) AS total FROM events GROUP BY ALL",
    "streaming_learn": "SELECT w, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)) AS w FROM documents) GROUP BY w",
    "sliding_windows": "SELECT begin, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS begin FROM events) GROUP BY begin",
    "session_windows": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS begin, count(*) AS n FROM s GROUP BY user_id, k",
}
QUERIES = {n: globals()[n] for n in [*SQL, "character_alignment", "feedback_evaluation"]}
