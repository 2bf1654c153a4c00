"""Connected components by alternating large and small stars: links only, never a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.storage import dropped, written


def _by(df: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """df with least's column m. Joined on a hash besides, so that the rows are dealt anew and adaptive execution can split a hot key."""
    a, b = df.withColumn("h", F.xxhash64(key)), least.withColumn("h", F.xxhash64(key))
    return a.join(b, ["h", key]).drop("h")


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): node, component (the smallest node that it reaches), for each node that isn't the smallest of its own."""
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "links")
    mark = lambda d: d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    before = mark(e)
    while before[0]:
        # large star: what is above u hangs on the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _by(both, "u", both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        # small star: u and what is below it hang on the smallest of these
        small = _by(large, "u", large.groupBy("u").agg(F.min("v").alias("m")))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, e = e, written(small, "small")
        dropped(old, large)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
