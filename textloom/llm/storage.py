"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.storage import cleaned

#: Tables not deleted yet.
_written: dict[str, SparkSession] = {}


def column(name: str) -> Column:
    """The column of just that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches to and from Python of at most `rows` documents (Spark's default is 10,000), as some texts are very long: a worker holds a batch and what is made of it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset, as in tests on one machine, a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
        folder = f"file://{folder}"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table to the shared folder and read again: computed once, and safe when executors are lost. What was shuffled for it goes at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._textloom_path = path
    _written[path] = spark
    return read


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for files that aren't a table; deleted at the end like the tables."""
    path = f"{shared_folder(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def dropped(*tables: DataFrame) -> None:
    """Deletes what `written` wrote, once nothing reads it any more: all that was made of it must have been written itself."""
    for table in tables:
        path = table._textloom_path
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone by now; the folder is the cluster's to clear
            return
