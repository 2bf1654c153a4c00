"""Checks of numbers read from documents: reference ranges, doses, look-back to the nearest name. They flag, they never correct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Plausible ranges (least, most).
RANGES = {
    "hba1c": (4.0, 15.0), "glucose": (1.0, 50.0), "sodium": (100.0, 180.0), "potassium": (1.5, 9.0), "chloride": (70.0, 130.0), "bicarbonate": (5.0, 45.0), "urea": (0.5, 80.0), "creatinine": (20.0, 2000.0),
    "hemoglobin": (3.0, 25.0), "wbc": (0.1, 100.0), "platelets": (5.0, 1500.0), "inr": (0.5, 10.0), "crp": (0.0, 500.0), "esr": (0.0, 150.0), "tsh": (0.01, 100.0), "troponin": (0.0, 50000.0), "lactate": (0.1, 20.0),
    "albumin": (5.0, 60.0), "bilirubin": (0.0, 500.0), "alt": (0.0, 5000.0), "ast": (0.0, 5000.0), "alp": (0.0, 2000.0), "calcium": (1.0, 4.5), "magnesium": (0.3, 3.0), "phosphate": (0.3, 5.0), "ph": (6.8, 7.8),
}
MOST_MG, MOST_INSULIN, LOOK_BACK, NAME_MARGIN = 5000.0, 200.0, 3, 1.5


def ranges(spark: SparkSession, table: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """name, least, most: a row for each entry of the parameter."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(a).alias("least"), F.lit(b).alias("most")) for k, (a, b) in sorted(table.items())])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def leading_number(raw: Column) -> Column:
    """The number at the beginning, a comma read as a point; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(raw, ",", "."), r"^\s*[+-]?[0-9]*\.?[0-9]+", 0), F.lit("")).try_cast("double")


def shifted_points(raw: Column, least: Column, most: Column) -> Column:
    """The values within the range that another place of the decimal point would give."""
    s = F.regexp_replace(raw, ",", ".")
    at = lambda i: F.concat(F.substring(s, F.lit(1), i), F.lit("."), F.substring(s, i + 1, F.length(s)))
    found = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.when(F.substring(s, i + 1, F.lit(1)) != ".", leading_number(at(i))))
    return F.when(F.length(s) > 1, F.filter(found, lambda v: v.isNotNull() & (v >= least) & (v <= most))).otherwise(F.array().cast("array<double>"))


def check_ranges(values: DataFrame, table: DataFrame) -> DataFrame:
    """values (name, raw, and more) with value, status, severity, alternatives. table: a dimension; broadcast as it comes from a parameter."""
    j = values.join(F.broadcast(table.withColumnRenamed("name", "__name")), F.lower(F.regexp_replace("name", r"\s+", "")) == F.col("__name"), "left").withColumn("value", leading_number(F.col("raw")))
    inside = (F.col("value") >= F.col("least")) & (F.col("value") <= F.col("most"))
    status = F.when(F.col("__name").isNull(), "unknown_lab").when(F.col("value").isNull(), "parse_error").when(inside, "in_range").otherwise("OUT_OF_RANGE")
    alt = F.when(status == "OUT_OF_RANGE", shifted_points(F.col("raw"), F.col("least"), F.col("most")))
    out = j.withColumn("status", status).withColumn("alternatives", alt)
    return out.withColumn("severity", F.when(F.col("status") == "OUT_OF_RANGE", F.when(F.size("alternatives") > 0, "warning").otherwise("error"))).drop("__name", "least", "most")


def nearest_before(tokens: DataFrame, line: str, pos: list[str], marked: Column, value: Column, reach: int = LOOK_BACK) -> DataFrame:
    """tokens with `before`: the value of the nearest marked token at most `reach` places back in the same line. pos: the order in a line, total."""
    w = Window.partitionBy(line).orderBy(*pos).rowsBetween(-reach, -1)
    return tokens.withColumn("before", F.last(F.when(marked, value), ignorenulls=True).over(w))


def implausible_dose(name: Column, value: Column, unit: Column) -> Column:
    return ((unit == "mg") & (value > MOST_MG)) | ((F.lower(name) == "insulin") & (value > MOST_INSULIN))


def ambiguous_names(ranked: DataFrame, dangerous: DataFrame, margin: float = NAME_MARGIN) -> DataFrame:
    """Queries whose two best candidates are both dangerous names and about as near. ranked: query, word, rank, distance."""
    two = ranked.where("rank <= 2").join(dangerous.select("word").distinct(), "word", "left_semi")
    g = two.groupBy("query").agg(F.count("*").alias("n"), F.min_by("word", "rank").alias("first"), F.max_by("word", "rank").alias("second"), (F.max_by("distance", "rank") - F.min_by("distance", "rank")).alias("gap"))
    return g.where((F.col("n") == 2) & (F.round("gap", 9) < margin)).drop("n")
