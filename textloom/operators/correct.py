"""Correction of damaged words against a vocabulary: blocking join, weighted distance, signals, evidence gate, flags, roll-ups.

The plan follows the guards: tokens that a rule or a vocabulary lookup settles never reach the fuzzy part, and each distinct token is
corrected once and joined back. Candidates come from an inverted index of keys (equi-joins, no cross join); the distance is
computed once a pair, for whole batches of pairs; the ranking a window per query, limited before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.distance import STATIC_COSTS, weighted_distance

#: Fixed values.
NUMBER, TITLE = r"^[\d.,/\-:]+$", r"(?i)^(dr|mr|mrs|ms|prof)\.?$"
DOSAGE = r"(?i)^[\dOoIl]+(\.[\dOoIl]+)?\s*(mg|mcg|g|ml|units?|iu|%|mmol|meq)$"
SHAPE = {"first": 3.0, "last": 2.0, "prefix": 2.0, "suffix": 1.0, "length": 0.75}
MAX_CANDIDATES, TOP = 768, 5
SIGNALS = 8
GATE = {"short": 0.35, "long": 0.55}


def keyed(f: DataFrame, word: str, spread: int = 0) -> DataFrame:
    """word, form, kind, key: the index form and the deletions of that. spread: on the query's side, the form meets deletions, too."""
    form = F.col("form")
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    dels = tx.deletions(form)
    # the query's own form and its deletions meet the vocabulary's forms and deletions
    cuts = F.concat(F.array(form), dels) if spread else dels
    keys = F.concat(F.array(entry("form", form)), F.transform(cuts, lambda k: entry("cut", k)))
    return f.select(word, "form", F.explode(keys).alias("k")).select(word, "form", "k.kind", "k.key").where("key <> ''")


def outline(word: Column, form: Column) -> Column:
    """All of a word that its shape score, and its keys by beginning and end, depend on."""
    return F.struct(F.substring(word, 1, 1).alias("first"), F.right(word, F.lit(1)).alias("last"), F.substring(form, 1, 2).alias("begin"), F.right(form, F.lit(2)).alias("end"), F.length(word).alias("n"))


def outline_score(q: Column, w: Column) -> Column:
    """+3 same first letter, +2 same last, +2 same two-letter beginning of the forms, +1 same ending, less 0.75 a letter of difference in length."""
    same = lambda name, x: F.when(q[name] == w[name], F.lit(x)).otherwise(F.lit(0.0))
    return same("first", SHAPE["first"]) + same("last", SHAPE["last"]) + same("begin", SHAPE["prefix"]) + same("end", SHAPE["suffix"]) - SHAPE["length"] * F.abs(q["n"] - w["n"])


def shape_score(query: Column, qform: Column, word: Column, wform: Column) -> Column:
    return outline_score(outline(query, qform), outline(word, wform))


def meeting_ends(q: Column, w: Column, spread: int) -> Column:
    """Do words of these outlines share their forms' beginning or end, with lengths that differ by up to `spread`?"""
    return ((q["begin"] == w["begin"]) | (q["end"] == w["end"])) & (F.abs(q["n"] - w["n"]) <= spread) & (w["n"] >= 1)


def best_by_outline(q: DataFrame, v: DataFrame, spread: int, limit: int) -> DataFrame:
    """o, best: for each outline of a query its `limit` best words (structs of minus shape and word, sorted) among those that share a
    beginning or an end. Outlines meet first, by levels of shape; words only follow for levels that can still be among the best, and of an
    outline no more than `limit`."""
    words = v.withColumn("r", F.row_number().over(Window.partitionBy("o").orderBy("word"))).where(F.col("r") <= limit)
    kept = words.groupBy("o").agg(F.sort_array(F.collect_list("word")).alias("words"))
    asked = q.select("o").distinct()

    def by(end):
        """Outlines that share the end, at each length that is near enough."""
        lengths = F.sequence(F.greatest(F.col("o")["n"] - spread, F.lit(1)), F.col("o")["n"] + spread)
        one = asked.select("o", F.col("o")[end].alias("key"), F.explode(lengths).alias("n"))
        other = kept.select(F.col("o").alias("w"), F.size("words").alias("k"), F.col("o")[end].alias("key"), F.col("o")["n"].alias("n"))
        return one.join(other, ["key", "n"]).select("o", "w", "k")

    begin, end = by("begin"), by("end").where(F.col("o")["begin"] != F.col("w")["begin"])
    scored = begin.unionByName(end).withColumn("minus", -outline_score(F.col("o"), F.col("w")))
    levels = scored.groupBy("o", "minus").agg(F.sum("k").alias("k"))
    open_ = levels.withColumn("before", F.sum("k").over(Window.partitionBy("o").orderBy("minus")) - F.col("k")).where(F.col("before") < limit)
    some = scored.join(open_.select("o", "minus"), ["o", "minus"], "left_semi").join(kept.select(F.col("o").alias("w"), "words"), "w")
    each = some.select("o", "minus", F.explode("words").alias("word"))
    ranked_ = each.withColumn("r", F.row_number().over(Window.partitionBy("o").orderBy("minus", "word"))).where(F.col("r") <= limit)
    return ranked_.groupBy("o").agg(F.sort_array(F.collect_list(F.struct("minus", "word"))).alias("best"))


def candidates(queries: DataFrame, vocab: DataFrame, max_len_diff: int = 1, limit: int = MAX_CANDIDATES) -> DataFrame:
    """query, word, shape: vocabulary words that share a key; the best `limit` by shape of each query. queries: query; vocab: word.

    A key is the form, a deletion of it, or its beginning or end with the length. The last two decide by a word's outline alone, so the best
    words for them are found once an outline, and a common ending costs no pair of each query with each word."""
    q = queries.select("query").where("query is not null").distinct().withColumn("form", tx.index_form(F.col("query"))).withColumn("o", outline(F.col("query"), F.col("form")))
    v = vocab.select("word").where("word is not null").distinct().withColumn("form", tx.index_form(F.col("word")))
    a, b = keyed(q, "query", max_len_diff).withColumnRenamed("form", "qform"), keyed(v, "word").withColumnRenamed("form", "wform")
    cut = a.join(b, ["kind", "key"]).where(F.abs(F.length("query") - F.length("word")) <= max_len_diff + 1)
    outlines = outline(F.col("query"), F.col("qform")), outline(F.col("word"), F.col("wform"))
    more = cut.where(~meeting_ends(*outlines, max_len_diff)).select("query", (-outline_score(*outlines)).alias("minus"), "word")
    # a pair may share several deletions
    more = more.groupBy("query").agg(F.collect_set(F.struct("minus", "word")).alias("more"))
    best = best_by_outline(q, v.withColumn("o", outline(F.col("word"), F.col("form"))), max_len_diff, limit)
    both = q.select("query", "o").join(best, "o", "left").join(more, "query", "left")
    none = F.array().cast("array<struct<minus:double,word:string>>")
    all_ = F.when(F.col("more").isNull(), F.col("best")).otherwise(F.slice(F.sort_array(F.concat(F.coalesce("best", none), F.col("more"))), 1, limit))
    return both.select("query", F.explode(all_).alias("c")).select("query", "c.word", (-F.col("c.minus")).alias("shape"))


def max_distance(n: Column, ocr: bool = False) -> Column:
    return F.when(n <= 4, F.greatest((0.45 if ocr else 0.35) * n, F.lit(1.0))).otherwise(F.greatest((0.55 if ocr else 0.45) * n, F.lit(2.0)))


def with_distance(pairs: DataFrame, costs: dict[str, float] = STATIC_COSTS) -> DataFrame:
    """distance (weighted), edit (plain)."""
    return pairs.withColumn("distance", weighted_distance(F.col("query"), F.col("word"), costs)).withColumn("edit", F.levenshtein(F.lower("query"), F.lower("word")))


def score(pairs: DataFrame, frequency: str | None = None) -> DataFrame:
    """pairs with the signals and their score: the mean of eight signals, and more if several agree. Signals that the caller has no column for are 0."""
    n, m = F.greatest(F.length("query"), F.lit(3)), F.abs(F.length("query") - F.length("word"))
    extra = lambda c: F.col(c) if c in pairs.columns else F.lit(0.0)
    s = [
        F.when(F.col("edit") == 0, F.lit(1.0)).otherwise(1 - F.col("distance") / F.col("edit")),
        extra("column_match"), F.least(extra(frequency or "frequency"), F.lit(1.0)), F.least(extra("chain"), F.lit(1.0)), F.least(extra("resonance"), F.lit(1.0)),
        F.greatest(F.lit(0.0), 1 - m / n), F.greatest(F.lit(0.0), 1 - F.col("distance") / n), F.lit(0.0),
    ]
    named = pairs.select("*", *[c.cast("double").alias(f"s{i + 1}") for i, c in enumerate(s)])
    strong = sum(((F.col(f"s{i + 1}") > 0.3).cast("int") for i in range(SIGNALS)), F.lit(0))
    mean = sum((F.col(f"s{i + 1}") for i in range(1, SIGNALS)), F.col("s1")) / SIGNALS
    return named.withColumn("score", mean + F.when(strong >= 3, 0.3).when(strong == 2, 0.1).otherwise(0.0))


def ranked(scored: DataFrame, k: int = TOP, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """The k best of each query (or of what `by` names) with rank and margin (to the next)."""
    # order by a rounded score, so that sums that differ in the last bit rank alike everywhere
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), F.round("distance", 9), "word")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("margin", F.round("score", 9) - F.coalesce(F.lead(F.round("score", 9)).over(w), F.lit(0.0)))


def evidence_gate(query: Column, distance: Column, edit: Column, word: Column, ocr: bool = False) -> Column:
    """True: the change isn't supported by how letters are mistaken for each other, the word stays as it is."""
    n, dl = F.length(query), F.abs(F.length(query) - F.length(word))
    mixed = query.rlike("[0-9]") & query.rlike("[A-Za-z]")
    ratio = F.when(edit > 0, distance / edit).otherwise(F.lit(0.0))
    short, long = (0.6, 0.8) if ocr else (GATE["short"], GATE["long"])
    weak = (ratio >= F.when(n <= 4, F.lit(short)).otherwise(F.lit(long))) & ~((edit <= 1) & (dl != 0)) & ~((edit <= 1) & (n >= 8))
    far = ((edit >= (6 if ocr else 3)) | ((edit >= (3 if ocr else 2)) & (n <= 5))) & (ratio >= 0.2)
    return ~mixed & (weak | far)


def confidence(best: Column, edit: Column) -> Column:
    return F.least(F.when(edit <= 1, F.greatest(best, F.lit(0.6))).otherwise(best), F.lit(1.0))


def policy(conf: Column, margin: Column, ambiguous: Column) -> Column:
    return F.when(ambiguous, "DANGER_medication_ambiguity").when((conf > 0.8) & (margin > 0.15), "high_confidence").when(conf > 0.5, "corrected_verify").otherwise("low_confidence")


def guard(word: Column) -> Column:
    """The flag of what needs no correction; null: look it up."""
    t = tx.trim_all(word)
    n = F.length(t)
    digits, letters = F.regexp_count(t, F.lit("[0-9]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    room = (n <= 6) & (digits > 0) & (letters > 0) & ~t.rlike(r"^[a-zA-Z]{2,}\d[a-zA-Z]{2,}$") & (((digits >= 2) & t.rlike("^[0-9]")) | ((t == F.upper(t)) & (n <= 5)) | t.contains("-"))
    return F.when(t == "", "empty").when(t.rlike(NUMBER), "number").when(t.rlike(TITLE), "title").when(t.rlike(DOSAGE), "dosage").when(room, "room_code").when(letters * 2 < n, "punctuation")


GUARD_CONFIDENCE = {"empty": 0.0, "number": 0.8, "title": 0.95, "dosage": 0.8, "room_code": 0.7, "short_unknown": 0.4, "punctuation": 0.6, "exact": 0.9, "clean": 0.85, "digraph_corrected": 0.85}


def correct_words(tokens: DataFrame, vocab: DataFrame, common: DataFrame | None = None, medications: DataFrame | None = None, ocr: bool = False) -> DataFrame:
    """For each distinct token (column query): corrected, confidence, flag, distance. vocab, common, medications: column word, lower case."""
    q = tokens.select("query").distinct().withColumn("lower", F.lower("query")).withColumn("fixed", tx.fix_digraphs(F.lower("query")))
    v = vocab.select(F.col("word")).distinct()
    flag = lambda d, key, name: d.join(v.select(F.col("word").alias(key), F.lit(True).alias(name)), key, "left")
    known = flag(flag(q, "lower", "known"), "fixed", "fixed_known")
    if common is not None:
        known = known.join(common.select(F.col("word").alias("lower"), F.lit(True).alias("common")).distinct(), "lower", "left")
    else:
        known = known.withColumn("common", F.lit(False))
    settled = F.coalesce(
        F.when(guard(F.col("query")) != "punctuation", guard(F.col("query"))),
        F.when((F.length("query") <= 3) & F.col("known").isNull(), "short_unknown"),
        guard(F.col("query")),
        F.when(F.col("known"), "exact"),
        F.when(F.col("common"), "clean"),
        F.when((F.col("fixed") != F.col("lower")) & F.col("fixed_known"), "digraph_corrected"),
    )
    marked = known.withColumn("flag", settled)
    conf = F.create_map(*[F.lit(x) for k, c in GUARD_CONFIDENCE.items() for x in (k, c)])
    done = marked.where("flag is not null").select("query", F.when(F.col("flag") == "digraph_corrected", tx.preserve_case(F.col("query"), F.col("fixed"))).otherwise(F.col("query")).alias("corrected"), F.try_element_at(conf, F.col("flag")).alias("confidence"), "flag", F.lit(None).cast("double").alias("distance"))
    open_ = marked.where("flag is null").select(F.col("lower").alias("query")).distinct()
    pairs = with_distance(candidates(open_, v, 2 if ocr else 1)).where(F.col("distance") <= max_distance(F.length("query"), ocr))
    best = ranked(score(pairs), 2)
    if medications is not None:
        best = best.join(medications.select("word", F.lit(True).alias("med")).distinct(), "word", "left")
    else:
        best = best.withColumn("med", F.lit(False))
    top = best.groupBy("query").agg(
        F.min_by("word", "rank").alias("word"), F.min_by("score", "rank").alias("score"), F.min_by("margin", "rank").alias("margin"), F.min_by("distance", "rank").alias("distance"), F.min_by("edit", "rank").alias("edit"),
        (F.count(F.when(F.col("med"), 1)) == 2).alias("both_meds"),
    )
    fuzzy = marked.where("flag is null").select("query", "lower").join(top.withColumnRenamed("query", "lower"), "lower", "left")
    danger = F.col("both_meds") & (F.col("margin") < 0.2) & (F.col("edit") > 1)
    c = F.when(danger, F.least(confidence(F.col("score"), F.col("edit")), F.lit(0.3))).otherwise(confidence(F.col("score"), F.col("edit")))
    gate = evidence_gate(F.col("query"), F.col("distance"), F.col("edit"), F.col("word"), ocr)
    flagged = fuzzy.withColumn("flag", F.when(F.col("word").isNull(), "unknown").when(gate, "clean").otherwise(policy(c, F.col("margin"), danger)))
    apply = (F.col("flag") == "high_confidence") | ((F.col("flag") == "corrected_verify") & (F.col("edit") <= 2))
    conf2 = F.when(F.col("flag").isin("unknown", "clean"), F.lit(0.0)).otherwise(c)
    return done.unionByName(flagged.select("query", F.when(apply, tx.preserve_case(F.col("query"), F.col("word"))).otherwise(F.col("query")).alias("corrected"), conf2.alias("confidence"), "flag", "distance"))


def decision(danger: Column, warning: Column, average: Column) -> Column:
    return F.when(danger, "reject").when(warning, "verify").when(average > 0.7, "accept").when(average > 0.4, "verify").otherwise("reject")


def correct_lines(lines: DataFrame, words: DataFrame) -> DataFrame:
    """line_id, corrected, n, confidence, decision. lines: line_id, text; words: the result of correct_words for the peeled tokens.

    The distinct words are joined back on the word; a frequent word lies on the side that adaptive execution can split."""
    t = lines.select("line_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "token")).where("token <> ''")
    lead, core, trail = tx.peel(F.col("token"))
    t = t.select("line_id", "pos", lead.alias("lead"), core.alias("query"), trail.alias("trail"))
    j = t.join(words, "query", "left").withColumn("flag", F.coalesce("flag", F.lit("punctuation"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.6)))
    out = F.concat("lead", F.coalesce("corrected", "query"), "trail")
    r = j.groupBy("line_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", out.alias("x")))), lambda s: s["x"]), " ").alias("corrected"), F.count("*").alias("n"), F.round(F.avg("confidence"), 2).alias("confidence"),
        F.bool_or(F.startswith("flag", F.lit("DANGER"))).alias("danger"), F.bool_or(F.col("flag").isin("low_confidence", "unknown", "corrected_verify", "short_unknown")).alias("warning"),
    )
    return r.select("line_id", "corrected", "n", "confidence", decision(F.col("danger"), F.col("warning"), F.col("confidence")).alias("decision"))
