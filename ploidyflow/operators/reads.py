"""Filtering and naming of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import PAIRED, PROPER_PAIR, UNUSABLE, strand


def read_filter(reads: DataFrame, min_mapq: int = 5) -> DataFrame:
    """Primary, usable, properly paired (or single) reads with a mapping quality."""
    flag = F.col("flag")
    return reads.where((flag.bitwiseAND(F.lit(UNUSABLE)) == 0) & ((flag.bitwiseAND(F.lit(PAIRED)) == 0) | (flag.bitwiseAND(F.lit(PROPER_PAIR)) != 0)) & (F.col("mapq") >= min_mapq))


def rename_reads(reads: DataFrame) -> DataFrame:
    """Adds the flag to each name, so that mates differ, and the strand (1: reverse)."""
    return reads.withColumn("qname", F.concat_ws("_", "qname", F.col("flag").cast("string"))).withColumn("strand", strand(F.col("flag")))
