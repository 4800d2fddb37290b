"""Alignments as SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, chrom, pos, mapq, cigar, seq of the file's reads; lines that begin with @ are its header."""
    part = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^@[A-Z]{2}\t") & (F.col("value") != ""))
    # filters on these columns may be tried on header lines first, so nothing here may fail
    text, number = lambda k: F.get(part, k), lambda k, kind: F.get(part, k).try_cast(kind)
    return lines.select(
        text(0).alias("qname"), number(1, "int").alias("flag"), text(2).alias("chrom"), number(3, "bigint").alias("pos"), number(4, "int").alias("mapq"), text(5).alias("cigar"), text(9).alias("seq")
    )


def sam_sort_order(spark: SparkSession, path: str) -> str:
    """SO of the header's first line, or "unspecified"."""
    row = spark.read.text(path).where(F.col("value").startswith("@HD\t")).select(F.regexp_extract("value", r"\tSO:(\S+)", 1).alias("so")).first()
    return row.so if row and row.so else "unspecified"
