"""Structured Streaming: windows over events, and counters learned from a stream of corrections.

Both are built from partial sums a micro-batch, written as a table a batch: sums may be added in any order, a batch that is run again
replaces its own table, and no operator state grows with the stream.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset and the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream, a few files a batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    files = spark.read.parquet(f"{sf_dir}/{name}.parquet").inputFiles()
    single = len(files) == 1 and files[0].endswith(f"/{name}.parquet")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(f"{sf_dir}/{name}.parquet")


def summed(stream: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Runs the stream over all that is there and returns the sums by key. sums: name to SQL expression of what is added up."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)

    def fold(batch: DataFrame, n: int) -> None:
        part = batch.groupBy(*keys).agg(*[F.sum(F.expr(x)).alias(name) for name, x in sums.items()])
        part.write.mode("overwrite").parquet(f"{at}/parts/batch={n}")

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    return spark.read.parquet(f"{at}/parts").groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sums])


def tumbling(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """begin, event_type, n, total: late events count in their own window, whenever they come."""
    keyed = stream.withColumn("begin", F.window("ts", width)["start"])
    return summed(keyed, ["begin", "event_type"], {"n": "1", "total": "cast(value as decimal(20, 6))"})


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width, step)["start"].alias("begin")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, begin, n: a session ends where the next event of its user is `gap` or more away."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("begin"), "n")


def last_of(events: DataFrame, k: int = 10) -> DataFrame:
    """The last k events of each user."""
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("r", r).where(F.col("r") <= k)
