"""Running sums within keys that may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.storage import written


def ranged(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """df, dealt by ranges of (key, order) and written, with `part`, the range: a key's rows lie in successive ranges, so even a key with most of all rows is spread over many tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, key, *order).withColumn("part", F.spark_partition_id()), "ranged")


def running(df: DataFrame, key: str, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """A table of `ranged` with the inclusive running sums within each key, in the same order. Each range adds up by itself; what a key
    has in the ranges before is added. At most one key a range began in a range before, so that side has as many rows as ranges and is broadcast."""
    totals = df.groupBy(key, "part").agg(*[F.sum(c).alias(f"total_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(key).alias("before_key"), F.col("part").alias("before_part"), *[F.sum(f"total_{n}").over(earlier).alias(f"before_{n}") for n in sums], F.count("*").over(earlier).alias("n_before"))
    before = before.where("n_before > 0").drop("n_before")
    local = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = df.select("*", *[F.sum(c).over(local).alias(f"local_{n}") for n, c in sums.items()])
    both = here.join(F.broadcast(before), (here[key] == before["before_key"]) & (here["part"] == before["before_part"]), "left")
    added = [(F.col(f"local_{n}") + F.coalesce(f"before_{n}", F.lit(0))).alias(n) for n in sums]
    return both.select(*[c for c in df.columns], *added)
