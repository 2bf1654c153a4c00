"""Learning from confirmed corrections, as aggregations over the table of events: any order, any batching gives the same counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.distance import STATIC_COSTS, weighted_distance
from textloom.operators import align

#: Fixed values.
EXPERIENCE, LEAST_CORRECTIONS, LEAST_COST, CHAIN = 50, 5, 0.05, 0.3
COLUMN_WEIGHTS = (
    ("medication", 3.0), ("med", 3.0), ("drug", 3.0), ("rx", 3.0), ("dose", 3.0), ("diagnosis", 2.5), ("dx", 2.5), ("lab", 2.5), ("result", 2.5), ("status", 2.0), ("triage", 2.0),
    ("doctor", 1.5), ("consultant", 1.5), ("patient", 1.5), ("name", 1.5), ("room", 1.0), ("bed", 1.0), ("ward", 1.0),
)


def substitutions(pairs: DataFrame, ocr: str, confirmed: str) -> DataFrame:
    """pair ('a,b' in order), n: letters that differ at the same place of words of equal length."""
    a, b = F.lower(ocr), F.lower(confirmed)
    at = lambda s, i: F.substring(s, i, F.lit(1))
    both = F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.struct(at(a, i).alias("x"), at(b, i).alias("y")))
    e = pairs.where((F.length(ocr) == F.length(confirmed)) & (F.length(ocr) > 0)).select(F.explode(F.filter(both, lambda p: p["x"] != p["y"])).alias("p"))
    return e.select(F.concat(F.least("p.x", "p.y"), F.lit(","), F.greatest("p.x", "p.y")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def adapted_cost(base: Column, n: Column, total: Column) -> Column:
    """The cost of a substitution after n of `total` corrections: base blended with experience."""
    seen = F.greatest(F.lit(LEAST_COST), 1 - 5 * n / total)
    share = F.least(total / EXPERIENCE, F.lit(1.0))
    return F.when((n == 0) | (total < LEAST_CORRECTIONS), base).otherwise(base * (1 - share) + seen * share)


def learned_costs(counts: DataFrame, total: int, base: dict[str, float] = STATIC_COSTS) -> dict[str, float]:
    """Costs for weighted_distance after `total` corrections. counts: pair, n (see substitutions, and aligned_counts where kind is error).

    The distance knows costs of the first 128 characters only, so at most 8,256 rows reach the driver, whatever was learned from."""
    plain = counts.where(F.col("pair").rlike("^[\\x00-\\x7F],[\\x00-\\x7F]$")).groupBy("pair").agg(F.sum("n").alias("n"))
    start = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in sorted(base.items()) for x in (k, v)]), F.col("pair")), F.lit(1.0))
    return base | {r.pair: r.cost for r in plain.select("pair", adapted_cost(start, F.col("n"), F.lit(total)).alias("cost")).collect()}


def frequency_boost(n: Column) -> Column:
    return F.log(1 + n) / F.log(F.lit(101.0))


def cells(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key, col, value in long form."""
    return rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(key, "x.col", "x.value")


def chains(rows: DataFrame, columns: list[str]) -> DataFrame:
    """ctx_col, ctx_val, tgt_col, token, n: what stands in a column when another holds a value; the whole value and each of its words. Paired within the row: no join."""
    value = lambda c: F.lower(F.col(c).cast("string"))
    pairs = [F.struct(F.lit(a).alias("ctx_col"), value(a).alias("ctx_val"), F.lit(b).alias("tgt_col"), F.concat(F.array(value(b)), F.filter(F.split(value(b), " "), lambda w: F.length(w) > 1)).alias("tokens")) for a in columns for b in columns if a != b]
    e = rows.select(F.explode(F.array(*pairs)).alias("x")).select("x.ctx_col", "x.ctx_val", "x.tgt_col", F.explode("x.tokens").alias("token"))
    return e.groupBy("ctx_col", "ctx_val", "tgt_col", "token").agg(F.count("*").alias("n"))


def predicted(chain: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("ctx_col", "ctx_val", "tgt_col").orderBy(F.desc("n"), "token")
    return chain.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def column_weight(name: Column) -> Column:
    """The weight of the first entry that the column's name contains; 1 if none."""
    w = F.lit(1.0)
    for part, x in reversed(COLUMN_WEIGHTS):
        w = F.when(F.lower(name).contains(part), F.lit(x)).otherwise(w)
    return w


def ema_weight(outcomes: Column, base: float = 1.0) -> Column:
    """An engine's weight after outcomes (1 right, 0 wrong, in order): from the fifth on, 0.9 w + 0.1 base * clamp(accuracy / 0.5, 0.1, 3)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("right"), F.lit(float(base)).alias("w"))

    def step(a: Column, x: Column) -> Column:
        n, right = a["n"] + 1, a["right"] + x
        target = base * F.least(F.greatest(right / n / 0.5, F.lit(0.1)), F.lit(3.0))
        return F.struct(n.alias("n"), right.alias("right"), F.when(n >= 5, 0.9 * a["w"] + 0.1 * target).otherwise(a["w"]).alias("w"))

    return F.aggregate(outcomes, start, step, lambda a: a["w"])


def experience_cost(base: Column, n: Column, total: Column) -> Column:
    """The other profile's cost: it falls exponentially with n, and counts as experience grows to 100 corrections; from ten on."""
    share = F.least(total / 100, F.lit(1.0))
    return F.when((n == 0) | (total < 10), base).otherwise(base * (1 - share) + (base * F.exp(-n / 10) + 0.05) * share)


def aligned_counts(pairs: DataFrame, ocr: str, confirmed: str, weight: Column | float = 1.0) -> DataFrame:
    """kind (error, ok), pair (two letters in order, or the letter), n: letters that an alignment puts against each other, whatever the words' lengths; a pair of words counts max(1, round(weight)) times."""
    times = F.greatest(F.lit(1), F.floor((F.lit(weight) if isinstance(weight, float) else weight) + 0.5)).cast("long")
    # each distinct pair of words is aligned once
    distinct = pairs.select(F.lower(ocr).alias("a"), F.lower(confirmed).alias("b"), times.alias("times")).where("a is not null and b is not null").groupBy("a", "b").agg(F.sum("times").alias("times"))
    e = distinct.select("times", F.explode(align.aligned_characters(F.col("a"), F.col("b"))).alias("x")).where("x.kind in ('match', 'substitution')")
    pair = F.when(F.col("x.kind") == "match", F.col("x.a")).otherwise(F.concat(F.least("x.a", "x.b"), F.lit(","), F.greatest("x.a", "x.b")))
    return e.select(F.when(F.col("x.kind") == "match", "ok").otherwise("error").alias("kind"), pair.alias("pair"), "times").groupBy("kind", "pair").agg(F.sum("times").alias("n"))


def letter_confidence(counts: DataFrame) -> DataFrame:
    """letter, confidence: the share of a letter's occurrences that were read right, of those with an error in which it takes part."""
    letters = F.when(F.col("kind") == "ok", F.array("pair")).otherwise(F.array(F.substring("pair", 1, 1), F.substring("pair", 3, 1)))
    e = counts.select("kind", "n", F.explode(letters).alias("letter"))
    return e.groupBy("letter").agg((F.sum(F.when(F.col("kind") == "ok", F.col("n")).otherwise(0)) / F.sum("n")).alias("confidence"))


def rejected_words(rows: DataFrame, vocab: DataFrame, key: list[str], costs: dict[str, float]) -> DataFrame:
    """key, word, distance: confirmed words of more than two letters that are unknown, aren't in what was read, and are further than max(0.8 of their letters, 4)
    from all of that. A learner leaves out the columns (key) that have any. rows: key, ocr, confirmed; vocab: word. Pairs are those of one row's words."""
    changed = rows.where((F.col("ocr") != "") & (F.col("confirmed") != "") & (F.col("ocr") != F.col("confirmed"))).withColumn("read", F.array_distinct(F.split(F.lower("ocr"), r"\s+")))
    w = changed.select(*key, "read", F.explode(F.array_distinct(F.split(F.lower("confirmed"), r"\s+"))).alias("word")).where((F.length("word") > 2) & ~F.array_contains("read", F.col("word")))
    unknown = w.join(vocab.select("word").distinct(), "word", "left_anti")
    d = unknown.select(*key, "word", F.explode("read").alias("r")).withColumn("distance", weighted_distance(F.col("word"), F.col("r"), costs))
    return d.groupBy(*key, "word").agg(F.min("distance").alias("distance")).where(F.col("distance") > F.greatest(F.length("word") * 0.8, F.lit(4.0)))
