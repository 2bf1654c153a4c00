"""Column functions over strings: tokenizers, case, OCR normalisation, digits and doses. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SENTENCE_END = r"[.!?\n]+"
MODEL_TOKEN = "[a-z0-9]{2,}"  # a run of letters and digits; one alone is no token
READER_TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
PROCESS_TOKEN = "[a-z0-9.]+"
SPACE = r"[ \t\n\x0B\f\r ﻿  ]"
SPACES = " \t\n\x0B\f\r ﻿  "
DIGRAPHS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("nn", "m"), ("ii", "u"), ("li", "h"), ("ri", "n"))
INDEX_FROM, INDEX_TO = "013568i", "olesgbl"
UNITS = ("mg", "mcg", "g", "ml", "units", "unit", "iu", "%", "mmol", "meq", "µg")
DIGIT_LOOKALIKES = {"O": "0", "o": "0", "I": "1", "l": "1"}
MIN_SENTENCE = 5


def trim_all(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def sentences(text: Column) -> Column:
    """Trimmed sentences of more than five characters."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), trim_all), lambda s: F.length(s) > MIN_SENTENCE)


def model_tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(MODEL_TOKEN), F.lit(0))


def reader_tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(READER_TOKEN), F.lit(0))


def process_tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(PROCESS_TOKEN), F.lit(0))


def peel(word: Column) -> tuple[Column, Column, Column]:
    """Leading marks, core, trailing marks."""
    lead = F.regexp_extract(word, "^[^a-zA-Z0-9]*", 0)
    rest = F.substring(word, F.length(lead) + 1, F.length(word))
    trail = F.regexp_extract(rest, "[^a-zA-Z0-9]*$", 0)
    return lead, F.substring(rest, F.lit(1), F.length(rest) - F.length(trail)), trail


def preserve_case(original: Column, corrected: Column) -> Column:
    """corrected in the case of original: all capitals, capitalised, lower or as it is."""
    first, rest = F.substring(original, 1, 1), F.substring(corrected, 2, 1 << 20)
    return (
        F.when((original == F.upper(original)) & (F.length(original) > 1), F.upper(corrected))
        .when((F.length(original) > 0) & (first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.substring(corrected, 1, 1)), F.lower(rest)))
        .when(original == F.lower(original), F.lower(corrected))
        .otherwise(corrected)
    )


def fix_digraphs(c: Column) -> Column:
    """Each pair of letters in turn, everywhere; the order matters."""
    for pair, one in DIGRAPHS:
        c = F.replace(c, F.lit(pair), F.lit(one))
    return c


def index_form(word: Column) -> Column:
    """Letters and digits in lower case, look-alikes folded."""
    return F.translate(F.regexp_replace(F.lower(word), "[^a-z0-9]", ""), INDEX_FROM, INDEX_TO)


def deletions(word: Column) -> Column:
    """The word with each character left out in turn, without repeats."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def prefix_key(word: Column, form: Column) -> Column:
    return F.concat(F.substring(form, 1, 2), F.lit(":"), F.length(word))


def suffix_key(word: Column, form: Column) -> Column:
    return F.concat(F.right(form, F.lit(2)), F.lit(":"), F.length(word))


def char_at(c: Column, i: Column) -> Column:
    return F.substring(c, i, F.lit(1))


def normalize_digits(c: Column) -> Column:
    """O, o, I and l beside a digit or another such letter become digits."""
    near = "[0-9OoIl]"
    fix = lambda i: F.when(
        char_at(c, i).isin(*DIGIT_LOOKALIKES) & (F.when(i > 1, char_at(c, i - 1)).otherwise("").rlike(near) | char_at(c, i + 1).rlike(near)),
        F.translate(char_at(c, i), "OoIl", "0011"),
    ).otherwise(char_at(c, i))
    return F.when(F.length(c) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(c)), fix), "")).otherwise(c)


def dose(token: Column) -> Column:
    """struct(text, value, unit, changes), or null if the token isn't a number with a unit."""
    pattern = "^([0-9OoIl.,]*[0-9OoIl])(" + "|".join(UNITS) + ")$"
    pattern = f"(?i){pattern}"
    number, unit = F.regexp_extract(token, pattern, 1), F.lower(F.regexp_extract(token, pattern, 2))
    # bound once: named again, it would be made again, for each place too
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))

    def read(number: Column, fixed: Column) -> Column:
        changes = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), lambda i: char_at(number, i) != char_at(fixed, i)))
        value = F.regexp_extract(F.regexp_replace(fixed, ",", "."), r"^[0-9]*\.?[0-9]+", 0).try_cast("double")
        return F.when((number != "") & fixed.rlike("[0-9]"), F.struct(F.concat(fixed, unit).alias("text"), value.alias("value"), unit.alias("unit"), changes.alias("changes")))

    return bound(number, lambda n: bound(normalize_digits(n), lambda fixed: read(n, fixed)))
