"""Documents from files: the type by extension or first bytes, delimited and plain text, JSON records; snapshots of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes (hexadecimal) and extensions.
MAGIC = (("25504446", "pdf"), ("89504E47", "image"), ("FFD8FF", "image"), ("424D", "image"), ("49492A00", "image"), ("4D4D002A", "image"))
EXTENSIONS = {"csv": "csv", "tsv": "tsv", "txt": "text", "md": "text", "json": "json", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "bmp": "image", "tif": "image", "tiff": "image"}


def type_of(path: Column, content: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    first = F.hex(F.substring(content, 1, 8))
    magic = F.lit("text")
    for m, kind in reversed(MAGIC):
        magic = F.when(F.startswith(first, F.lit(m)), kind).otherwise(magic)
    return F.coalesce(F.try_element_at(kinds, ext), magic)


def directory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, type, length of the files; contents are read only as far as the type needs them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", type_of(F.col("path"), F.col("content")).alias("type"), "length")


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Quoted fields, doubled quotes, fields of several lines; cells trimmed, missing ones empty."""
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no, line: without blank lines."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def seeds(rows: DataFrame, input_col: str, output: Column, at: Column) -> DataFrame:
    """Training records: id (seed_<time>_<first 8 of md5>), input_text, structured_output as JSON."""
    return rows.select(F.concat(F.lit("seed_"), at, F.lit("_"), F.substring(F.md5(F.col(input_col)), 1, 8)).alias("id"), F.col(input_col).alias("input_text"), F.to_json(output).alias("structured_output"))


def save_state(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """A versioned snapshot; its list of tables is written last, so a snapshot without it isn't one."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, n) for n in tables], "version int, name string").write.mode("overwrite").parquet(f"{path}/done/v{version}")


def load_state(spark: SparkSession, path: str, version: int) -> dict[str, DataFrame] | None:
    """The snapshot's tables, or None if it isn't there as a whole."""
    from pyspark.errors import AnalysisException

    try:
        names = [r["name"] for r in spark.read.parquet(f"{path}/done/v{version}").collect()]
        return {n: spark.read.parquet(f"{path}/v={version}/{n}") for n in names}
    except AnalysisException:
        return None
