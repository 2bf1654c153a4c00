"""Queries of whole lines, their safety and what is learned from them, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions.distance import STATIC_COSTS, cost_map
from textloom.operators import learn, lines, safety
from textloom.plans.correct_queries import SPL, _digits, _noisy, _vocab
from textloom.plans.record_queries import CONF, LABS, _base, confusion_counts
from textloom.sources.tables import table

UNITS = ["mg", "ml", "units", "g"]


def line_numbers(spark, sf_dir):
    """Lines made of line items: a number before a unit, and a dose in one word."""
    unit, number = F.element_at(F.array(*map(F.lit, UNITS)), F.col("l_linenumber") % 4 + 1), F.concat(F.translate(F.col("l_quantity").cast("int").cast("string"), "01", "Ol"), F.lit("5"))
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", F.lit("take"), number, unit, F.lit("or"), F.concat(number, unit)).alias("line"))
    return t.select("l_orderkey", "l_linenumber", "line", lines.normalized_numbers(F.col("line")).alias("x")).select("l_orderkey", "l_linenumber", "line", "x.text", "x.changed")


def exact_case(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \n\t]+")).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n")).select("token", "n", lines.exact_case(F.col("token")).alias("fixed"))


def noise_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lines.noise(F.col("text")).alias("noise"))


def column_kinds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", lines.column_kind(F.col("p_name"), F.split("p_name", " ")).alias("by_cells"), lines.column_kind(F.concat("p_brand", F.lit(" "), "p_name")).alias("by_text"))


def _words(spark, sf_dir):
    """Lines made of orders: laboratory names, numbers, medications and doses by the items' numbers."""
    n = F.col("l_linenumber") % 4
    word = (
        F.when(n == 1, F.element_at(F.array(*map(F.lit, LABS)), (F.col("l_partkey") % len(LABS) + 1).cast("int")))
        .when(n == 2, F.floor(F.col("l_extendedprice") / 10).cast("string"))
        .when(n == 3, F.when(F.col("l_partkey") % 2 == 0, "insulin").otherwise("tablet"))
        .otherwise(F.concat(F.floor("l_extendedprice").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, "mg").otherwise("units")))
    )
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_id"), pos.alias("pos"), word.alias("word"))


def line_safety(spark, sf_dir):
    names = spark.range(1).select(F.explode(F.array(F.lit("insulin"), F.lit("tablet"))).alias("word"))
    return lines.safety_flags(_words(spark, sf_dir), safety.ranges(spark), names).select("line_id", "pos", "status", "name", "word")


def rejected_corrections(spark, sf_dir):
    """Part names as read, the next part's type as confirmed; the names' words are known. Plain distances."""
    p = table(spark, sf_dir, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.lower("p_type").alias("confirmed"))
    rows = p.select("p_partkey", F.col("p_name").alias("ocr")).join(after, "p_partkey")
    known = p.select(F.explode(F.split(F.lower("p_name"), r"\s+")).alias("word")).distinct()
    return learn.rejected_words(rows, known, ["p_partkey"], {}).select("p_partkey", "word", F.col("distance").cast("int").alias("distance"))


def experience_cost(spark, sf_dir):
    n = confusion_counts(spark, sf_dir)
    base = F.coalesce(F.try_element_at(cost_map(STATIC_COSTS), F.col("pair")), F.lit(1.0))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("pair", "n", F.round(learn.experience_cost(base, F.col("n"), F.col("total")), 6).alias("cost"))


def aligned_confusions(spark, sf_dir):
    return learn.aligned_counts(_noisy(_vocab(spark, sf_dir)), "query", "word")


def letter_confidence(spark, sf_dir):
    return learn.letter_confidence(aligned_confusions(spark, sf_dir)).select("letter", F.round("confidence", 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (line_numbers, exact_case, noise_lines, column_kinds, line_safety, rejected_corrections, experience_cost, aligned_confusions, letter_confidence)}

_ranges = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in sorted(safety.RANGES.items()))
_labs = ", ".join(f"'{x}'" for x in LABS)
SQL = {
    "line_numbers": f"""WITH t AS (SELECT l_orderkey, l_linenumber, translate(l_quantity::INT::VARCHAR, '01', 'Ol') || '5' AS num, ['mg', 'ml', 'units', 'g'][l_linenumber % 4 + 1] AS unit FROM lineitem), f AS (SELECT *, {_digits('num')} AS fixed FROM t)
      SELECT l_orderkey, l_linenumber, 'take ' || num || ' ' || unit || ' or ' || num || unit AS line, 'take ' || fixed || ' ' || unit || ' or ' || fixed || unit AS text, CASE WHEN num <> fixed THEN 2 ELSE 0 END::INT AS changed FROM f""",
    "exact_case": f"""SELECT token, n, CASE WHEN token = upper(token) AND length(token) <= 5 OR substr(token, 1, 1) = upper(substr(token, 1, 1)) AND substr(token, 2) = lower(substr(token, 2)) THEN token ELSE lower(token) END AS fixed
      FROM (SELECT token, count(*) AS n FROM ({SPL}) GROUP BY token)""",
    "noise_lines": r"SELECT doc_id, length(regexp_replace(trim(text), '[^\p{L}\p{N}]', '', 'g')) < greatest(length(trim(text)) * 0.15::DOUBLE, 1) AS noise FROM documents",
    "column_kinds": """WITH t AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda c: length(c)) AS s, p_brand || ' ' || p_name AS line FROM part)
      SELECT p_partkey, coalesce(['ward_structure', 'names', 'diagnosis', 'names', 'ward_structure'][list_position(s, list_max(s))], 'diagnosis') AS by_cells,
        CASE WHEN regexp_matches(trim(line), '(?i)^w[a-z]*d?\\s*[0-9]') OR contains(lower(line), 'ward') THEN 'ward_structure' WHEN regexp_matches(trim(line), '^[0-9]') THEN 'diagnosis' WHEN regexp_matches(lower(line), 'icu|er|unassign|chronic') THEN 'ward_structure' END AS by_text FROM t""",
    "line_safety": f"""WITH w AS (SELECT l_orderkey AS line_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS pos, CASE l_linenumber % 4 WHEN 1 THEN [{_labs}][l_partkey % {len(LABS)} + 1] WHEN 2 THEN floor(l_extendedprice / 10)::BIGINT::VARCHAR
        WHEN 3 THEN CASE WHEN l_partkey % 2 = 0 THEN 'insulin' ELSE 'tablet' END ELSE floor(l_extendedprice)::BIGINT::VARCHAR || CASE WHEN l_suppkey % 2 = 0 THEN 'mg' ELSE 'units' END END AS word FROM lineitem),
      r(name, least, most) AS (VALUES {_ranges}),
      n AS (SELECT a.line_id, a.pos, a.word, max_by(b.word, b.pos) AS name FROM w a JOIN w b ON b.line_id = a.line_id AND b.pos BETWEEN a.pos - 3 AND a.pos - 1 JOIN r ON r.name = b.word WHERE regexp_matches(a.word, '^[0-9.,]+$') GROUP BY a.line_id, a.pos, a.word),
      d AS (SELECT a.line_id, a.pos, a.word, b.word AS name, TRY_CAST(regexp_extract(a.word, '^[0-9]+') AS DOUBLE) AS value FROM w a JOIN w b ON b.line_id = a.line_id AND b.pos = a.pos - 1 WHERE b.word IN ('insulin', 'tablet') AND regexp_matches(a.word, '[0-9]'))
      SELECT line_id, pos, 'OUT_OF_RANGE' AS status, name, word FROM n JOIN r USING (name) WHERE TRY_CAST(word AS DOUBLE) NOT BETWEEN least AND most
      UNION ALL SELECT line_id, pos, 'IMPLAUSIBLE_DOSE', name, word FROM d WHERE word LIKE '%mg' AND value > 5000 OR name = 'insulin' AND value > 200""",
    "rejected_corrections": r"""WITH k AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(p_name), '\s+')) AS word FROM part), x AS (SELECT a.p_partkey, lower(a.p_name) AS ocr, unnest(list_distinct(regexp_split_to_array(lower(b.p_type), '\s+'))) AS word FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
      y AS (SELECT p_partkey, word, unnest(regexp_split_to_array(ocr, '\s+')) AS r FROM x WHERE length(word) > 2 AND word NOT IN (SELECT word FROM k)), d AS (SELECT p_partkey, word, min(levenshtein(word, r))::INT AS distance FROM y GROUP BY p_partkey, word)
      SELECT * FROM d WHERE distance > greatest(length(word) * 0.8::DOUBLE, 4)""",
    "experience_cost": f"{CONF}, t AS (SELECT sum(n) AS total FROM cc), b AS (SELECT pair, n, total, {_base} AS base, least(total / 100, 1) AS share FROM cc, t) SELECT pair, n, round(CASE WHEN total < 10 THEN base ELSE base * (1 - share) + (base * exp(-n / 10) + 0.05::DOUBLE) * share END, 6) AS cost FROM b",
}
