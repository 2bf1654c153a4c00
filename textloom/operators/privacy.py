"""Redaction of identifiers: civil numbers, record numbers, dates of birth, telephone numbers, in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns in the order in which they are applied.
CIVIL = r"\b[123]\d{11}\b"
RECORD = r"(?i)\b(?:MRN|File|ID)[:\s#]*(\d{6,8})\b"
BIRTH = r"(?i)\b(?:DOB|D\.O\.B|Date of Birth)[:\s]*\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b"
PHONE = r"(?:\+965[\s-]?)?\b\d{4}[\s-]?\d{4}\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def redact(text: Column) -> Column:
    """text with every identifier replaced by its type."""
    t = F.regexp_replace(text, CIVIL, "[[CID]]")
    t = F.regexp_replace(t, r"(?i)\b(MRN|File|ID)([:\s#]*)\d{6,8}\b", "$1$2[[MRN]]")
    t = F.regexp_replace(t, BIRTH, "[[DOB]]")
    t = F.regexp_replace(t, PHONE, "[[PHN]]")
    return F.regexp_replace(t, EMAIL, "[[EML]]")


def counts(text: Column) -> list[Column]:
    n = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return [n(CIVIL).alias("civil"), n(RECORD).alias("record"), n(BIRTH).alias("birth"), n(PHONE).alias("phone"), n(EMAIL).alias("email")]


def findings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, type, token (numbered within the document over all types), sha256 of the original: the mapping table."""
    # telephone numbers are sought in what the other patterns have left
    left = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text_col), CIVIL, "[[CID]]"), RECORD, "[[MRN]]"), BIRTH, "[[DOB]]")

    def of(kind: str, text: Column, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("original")))

    text = F.col(text_col)
    found = F.concat(of("CID", text, CIVIL, 0), of("MRN", text, RECORD, 1), of("DOB", text, BIRTH, 0), of("PHN", left, PHONE, 0))
    e = docs.select(id_col, F.posexplode(found).alias("n", "x"))
    return e.select(id_col, F.col("x.type").alias("type"), F.concat(F.lit("[["), F.col("x.type"), F.lit("_"), F.lpad(F.col("n").cast("string"), 4, "0"), F.lit("]]")).alias("token"), F.sha2("x.original", 256).alias("hash"))
