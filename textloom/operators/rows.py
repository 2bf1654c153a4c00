"""Rows of a table, corrected column by column from left to right: what a column became is context for the next ones.

The loop runs over the columns of the schema, never over rows. Words that a guard or a lookup settles are settled once for the whole table;
candidates and distances are computed once a distinct open word. Only the ranking depends on the row: it is done once for each distinct
pair of open word and context, and joined back. The word before doesn't enter a correction, so another pass over a line would change nothing.

A line is a row with one column. Null and blank cells stay as they are and give no context; the key must tell the rows apart; a column's
name may hold any characters; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.distance import STATIC_COSTS
from textloom.operators import correct, learn, lines, safety
from textloom.sources.storage import stored

KNOWN = "array<struct<col:string,val:string>>"
WORD = "struct<pos:int,original:string,corrected:string,confidence:double,flag:string>"
#: The share of a word's frequency in its confidence, flags that call for a look.
BOOST_SHARE, DANGER_CONFIDENCE, DANGER_MARGIN = 0.1, 0.3, 0.2
WARNINGS = ("corrected_verify", "low_confidence", "unknown", "short_unknown")
PARTNERS = 20


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"{tx.SPACE}+"), lambda w: w != "")


def settled(cores: DataFrame, words: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """core, lower, flag, corrected, confidence: flag is null where a word has to be looked for. cores: core; words: word, base, boost; common: word."""
    q = cores.select("core").distinct().withColumn("lower", F.lower("core")).withColumn("fixed", tx.fix_digraphs(F.col("lower")))
    look = lambda name: words.select(F.col("word").alias(name), F.col("base").alias(f"{name}_base"), F.col("boost").alias(f"{name}_boost"))
    known = q.join(look("lower"), "lower", "left").join(look("fixed"), "fixed", "left")
    if common is None:
        known = known.withColumn("common", F.lit(False))
    else:
        known = known.join(common.select(F.col("word").alias("lower"), F.lit(True).alias("common")).distinct(), "lower", "left")
    guard, word = correct.guard(F.col("core")), F.col("core")
    flag = F.coalesce(
        F.when(word == "", "punctuation"),
        F.when(guard != "punctuation", guard),
        F.when((F.length(word) <= 3) & ~F.coalesce("lower_base", F.lit(False)), "short_unknown"),
        guard,
        F.when(F.col("lower_base").isNotNull(), "exact"),
        F.when(F.col("common"), "clean"),
        F.when((F.col("fixed") != F.col("lower")) & F.col("fixed_base").isNotNull(), "digraph_corrected"),
    )
    sure = F.create_map(*[F.lit(x) for k, c in correct.GUARD_CONFIDENCE.items() for x in (k, c)])
    return known.withColumn("flag", flag).select(
        "core", "lower", "flag",
        F.when(F.col("flag") == "exact", lines.exact_case(word)).when(F.col("flag") == "digraph_corrected", tx.preserve_case(word, F.col("fixed"))).otherwise(word).alias("corrected"),
        F.when(F.col("flag") == "exact", F.least(correct.GUARD_CONFIDENCE["exact"] + BOOST_SHARE * F.col("lower_boost"), F.lit(1.0))).otherwise(F.try_element_at(sure, F.col("flag"))).alias("confidence"),
    )


def pairs(open_: DataFrame, words: DataFrame, resonance: DataFrame | None, costs: dict[str, float], ocr: bool) -> DataFrame:
    """query, word, distance, edit, frequency, resonance: the near words of each open word. open_: query; resonance: a, b, resonance."""
    n = F.length("query")
    apart = F.when(n <= 4, 2 if ocr else 1).otherwise(3 if ocr else 2)
    found = correct.candidates(open_, words, 2 if ocr else 1).where(F.abs(n - F.length("word")) <= apart)
    near = correct.with_distance(found, costs).where(F.col("distance") <= correct.max_distance(n, ocr)).join(words.select("word", F.col("boost").alias("frequency")), "word")
    if resonance is None:
        return near.withColumn("resonance", F.lit(0.0))
    return near.join(resonance.select(F.col("a").alias("query"), F.col("b").alias("word"), "resonance"), ["query", "word"], "left").fillna(0.0, ["resonance"])


def partners(res: DataFrame, words: DataFrame, k: int = PARTNERS) -> DataFrame:
    """a, b, resonance: the discounts of the k strongest partners of the words. res: a, b, resonance (graph.batch_resonance); words: query."""
    from textloom.operators import graph

    mine = res.join(words.select(F.col("query").alias("a")).distinct(), "a", "left_semi")
    return graph.top(mine, k, "a", "b", "resonance").select("a", "b", graph.discount(F.col("resonance")).alias("resonance"))


def decided(situations: DataFrame, near: DataFrame, col: str, column_words: DataFrame | None, chains: DataFrame | None, medications: DataFrame | None) -> DataFrame:
    """known, lower, best, score, margin, distance, edit, both: the best word of each open word in its context. situations: known, lower."""
    s = situations.withColumnRenamed("lower", "query").join(near, "query")
    if column_words is not None:
        mine = column_words.where(F.lower("col") == col.lower()).select("word", F.lit(1.0).alias("column_match")).distinct()
        s = s.join(mine, "word", "left").fillna(0.0, ["column_match"])
    if chains is not None:
        into = chains.where(F.lower("tgt_col") == col.lower()).select("ctx_col", "ctx_val", F.col("token").alias("word"), "n")
        # a candidate meets the chains by context and word, so a context that many rows share isn't multiplied by all it leads to
        known = s.select("known", "query", "word", F.explode("known").alias("k")).select("known", "query", "word", F.col("k.col").alias("ctx_col"), F.col("k.val").alias("ctx_val"))
        boost = known.join(into, ["ctx_col", "ctx_val", "word"]).groupBy("known", "query", "word").agg(F.sum(learn.CHAIN * F.log(1 + F.col("n"))).alias("chain"))
        s = s.join(boost, ["known", "query", "word"], "left").fillna(0.0, ["chain"])
    top = correct.ranked(correct.score(s), 2, ("known", "query"))
    if medications is None:
        top = top.withColumn("med", F.lit(None).cast("boolean"))
    else:
        top = top.join(medications.select(F.lower("word").alias("word"), F.lit(True).alias("med")).distinct(), "word", "left")
    first = lambda c: F.min_by(c, "rank").alias(c)
    return top.groupBy("known", F.col("query").alias("lower")).agg(F.min_by("word", "rank").alias("best"), first("score"), first("margin"), first("distance"), first("edit"), (F.count("med") == 2).alias("both"))


def applied(t: DataFrame, ocr: bool) -> Column:
    """struct(corrected, confidence, flag) of a token with its settled columns and those of `decided`."""
    core, edit = F.col("core"), F.col("edit")
    danger = F.col("both") & (F.round("margin", 9) < DANGER_MARGIN) & (edit > 1)
    sure = correct.confidence(F.col("score"), edit)
    conf = F.when(danger, F.least(sure, F.lit(DANGER_CONFIDENCE))).otherwise(sure)
    gate = correct.evidence_gate(core, F.round("distance", 9), edit, F.col("best"), ocr)
    flag = F.when(F.col("best").isNull(), "unknown").when(gate, "clean").otherwise(correct.policy(F.round(conf, 9), F.round("margin", 9), danger))
    change = (flag == "high_confidence") | ((flag == "corrected_verify") & (edit <= 2))
    out = F.when(change, tx.preserve_case(core, F.col("best"))).otherwise(core)
    settled_ = F.struct(F.col("corrected"), F.col("confidence"), F.col("flag"))
    return F.when(F.col("flag").isNotNull(), settled_).otherwise(F.struct(out.alias("corrected"), F.when(flag.isin("unknown", "clean"), 0.0).otherwise(conf).alias("confidence"), flag.alias("flag")))


def with_numbers(words: Column) -> Column:
    """words (of one cell, in order) with doses and numbers before a unit in digits; number and dosage flags tell so."""
    fixed = F.split(lines.normalized_numbers(F.array_join(F.transform(words, lambda w: w["corrected"]), " "))["text"], " ")

    def one(w: Column, i: Column) -> Column:
        new = F.get(fixed, i)
        flag = F.when((new != w["corrected"]) & w["flag"].isin("dosage", "number"), "dose_normalized").otherwise(w["flag"])
        return w.withField("corrected", new).withField("flag", flag).withField("renumbered", new != w["corrected"])

    return F.transform(words, one)


def correct_rows(
    rows: DataFrame, key: str, columns: list[str], vocab: DataFrame, column_words: DataFrame | None = None, frequency: DataFrame | None = None, chains: DataFrame | None = None,
    resonance: DataFrame | None = None, common: DataFrame | None = None, medications: DataFrame | None = None, costs: dict[str, float] = STATIC_COSTS, ocr: bool = False,
) -> DataFrame:
    """row, at, col, input, output, words (pos, original, corrected, confidence, flag, renumbered): every cell.

    vocab: word, lower case. column_words: col, word that a column expects. frequency: word, n of confirmed words, which are known too.
    chains: see learn.chains. resonance: a, b, resonance as graph.batch_resonance gives it. common: word that is never corrected.
    costs: of letters, e. g. learn.learned_costs."""
    base = vocab.select("word").where("word is not null").distinct().withColumn("base", F.lit(True))
    if frequency is None:
        words = base.withColumn("boost", F.lit(0.0))
    else:
        counts = frequency.where("word is not null").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")).where("n > 0")
        words = base.join(counts, "word", "full").select("word", F.coalesce("base", F.lit(False)).alias("base"), learn.frequency_boost(F.coalesce("n", F.lit(0))).alias("boost"))
    words = stored(words, "words")
    # each column asks these again
    column_words, chains, medications = (None if df is None else stored(df, "given") for df in (column_words, chains, medications))
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    state = rows.select(named(key).alias("row"), F.array().cast(KNOWN).alias("known"), F.array(*[named(c).cast("string") for c in columns]).alias("texts"))
    cores = state.select(F.explode("texts").alias("text")).select(F.explode(tokens(F.col("text"))).alias("token")).select(tx.peel(F.col("token"))[1].alias("core"))
    done = stored(settled(cores, words, common), "settled")
    open_ = done.where("flag is null").select(F.col("lower").alias("query")).distinct()
    near = stored(pairs(open_, words, None if resonance is None else partners(resonance, open_), costs, ocr), "near")
    cells = None
    for at, col in enumerate(columns):
        lead, core, trail = tx.peel(F.col("token"))
        text = F.get("texts", F.lit(at))
        t = state.select("row", "known", "texts", F.posexplode_outer(tokens(text)).alias("pos", "token")).select("*", lead.alias("lead"), core.alias("core"), trail.alias("trail")).join(done, "core", "left")
        asked = t.where("token is not null and flag is null").select("known" if chains is not None else F.array().cast(KNOWN).alias("known"), "lower").distinct()
        best = decided(asked, near, col, column_words, chains if at else None, medications)
        best = best.withColumnRenamed("lower", "of").withColumnRenamed("known", "given")
        same = F.col("lower") == F.col("of")
        j = t.join(best, same & (F.col("known") == F.col("given")) if chains is not None else same, "left")
        x = applied(j, ocr)
        word = F.struct("pos", F.col("token").alias("original"), F.concat("lead", x["corrected"], "trail").alias("corrected"), x["confidence"].alias("confidence"), x["flag"].alias("flag")).cast(WORD)
        g = j.groupBy("row").agg(F.first("known").alias("known"), F.first("texts").alias("texts"), F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), word))).alias("words"))
        out = F.when(F.size("words") > 0, F.array_join(F.transform("words", lambda w: w["corrected"]), " ")).otherwise(F.get("texts", F.lit(at)))
        g = g.withColumn("words", with_numbers(F.col("words"))).withColumn("output", out)
        context = F.when(F.size("words") > 0, F.array(F.struct(F.lit(col.lower()).alias("col"), F.lower("output").alias("val")))).otherwise(F.array().cast(KNOWN))
        state = stored(g.withColumn("known", F.concat("known", context.cast(KNOWN))), "column")
        cell = state.select("row", F.lit(at).alias("at"), F.lit(col).alias("col"), F.get("texts", F.lit(at)).alias("input"), "output", "words")
        cells = cell if cells is None else cells.unionByName(cell)
        state = state.select("row", "known", "texts")
    return cells


def cell_flags(cells: DataFrame, ranges: DataFrame, medications: DataFrame) -> DataFrame:
    """row, at, pos, status, severity, name, word: numbers out of range, implausible doses, names that may be another medication, rewritten numbers."""
    w = cells.select(F.struct("row", "at").alias("cell"), F.explode("words").alias("w")).select("cell", F.col("w.pos").alias("pos"), F.col("w.corrected").alias("word"), "w.flag", "w.renumbered")
    found = lines.safety_flags(w.select("cell", "pos", "word"), ranges, medications, line="cell")
    also = lambda where, status, severity: w.where(where).select("cell", "pos", F.lit(status).alias("status"), F.lit(severity).alias("severity"), F.lit(None).cast("string").alias("name"), "word")
    every = found.unionByName(also("flag = 'DANGER_medication_ambiguity'", "MEDICATION_AMBIGUITY", "danger")).unionByName(also("renumbered", "DOSE_NORMALIZED", "warning"))
    return every.select("cell.row", "cell.at", "pos", "status", "severity", "name", "word")


def decisions(cells: DataFrame, flags: DataFrame) -> DataFrame:
    """row, n_words, confidence, n_flags, dangers, warnings, decision of each row: of all its cells' words and flags."""
    conf = F.aggregate("words", F.lit(0.0), lambda s, w: s + w["confidence"])
    doubt = F.exists("words", lambda w: w["flag"].isin(*WARNINGS))
    r = cells.groupBy("row").agg(F.sum(F.size("words")).alias("n_words"), F.sum(conf).alias("total"), F.bool_or(doubt).alias("doubt"))
    f = flags.groupBy("row").agg(F.count("*").alias("n_flags"), F.bool_or(F.col("severity") == "danger").alias("dangers"), F.bool_or(F.col("severity").isin("warning", "error")).alias("flagged"))
    j = r.join(f, "row", "left").fillna(False, ["dangers", "flagged"]).fillna(0, ["n_flags"])
    mean = F.when(F.col("n_words") > 0, F.round(F.col("total") / F.col("n_words") + 1e-9, 2)).otherwise(0.0)
    j = j.select("row", "n_words", mean.alias("confidence"), "n_flags", "dangers", (F.col("doubt") | F.col("flagged")).alias("warnings"))
    return j.withColumn("decision", correct.decision(F.col("dangers"), F.col("warnings"), F.col("confidence")))
