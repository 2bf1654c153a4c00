"""Layout of detected boxes: rows and columns as gaps and islands, columns as ranges, words that anchor a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_GAP, COLUMN_GAP, COLUMN_MEMBERS, ANCHOR = 20, 25, 3, 2


def islands(points: DataFrame, group: str, at: str, gap: float, order: tuple[str, ...] = ()) -> DataFrame:
    """points with island: a new one begins where `at` is more than gap beyond the point before."""
    w = Window.partitionBy(group).orderBy(at, *order)
    new = points.withColumn("new", F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True)).cast("int"))
    return new.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def columns(points: DataFrame, group: str, x: str, gap: float = COLUMN_GAP, members: int = COLUMN_MEMBERS) -> DataFrame:
    """group, column, from, to, n: clusters of starts with enough members."""
    c = islands(points, group, x, gap).groupBy(group, "island").agg(F.min(x).alias("from"), F.max(x).alias("to"), F.count("*").alias("n")).where(F.col("n") >= members)
    return c.withColumn("column", F.row_number().over(Window.partitionBy(group).orderBy("from"))).drop("island")


def in_columns(points: DataFrame, cols: DataFrame, group: str, x: str) -> DataFrame:
    """points with their column: the range join goes by group first, so each page meets its own columns only."""
    return points.join(cols.select(group, "column", "from", "to"), group).where(F.col(x).between(F.col("from"), F.col("to"))).drop("from", "to")


def anchors(words: DataFrame, group: str, column: str, word: str, least: int = ANCHOR) -> DataFrame:
    return words.groupBy(group, column, word).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def decided(n: Column) -> Column:
    return F.when(n > 0, "filled").otherwise("empty")
