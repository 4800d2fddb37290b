"""Depth of contigs and of the genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cigars import ref_span
from ..functions.numbers import half_even


class NoDepthError(ValueError):
    """The contigs have no length, so no depth can be told."""


def contig_depth(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """chrom, length, mean (two places): covered bases by length; contigs without reads have none."""
    spans = reads.groupBy("chrom").agg(F.sum(ref_span(F.col("cigar"))).alias("bases"))
    return contigs.select("chrom", "length").join(spans, "chrom").select("chrom", "length", F.round(F.col("bases") / F.col("length"), 2).alias("mean"))


def genome_depth(depths: DataFrame) -> DataFrame:
    """One row: the length-weighted mean depth of all contigs, halves to even; null without length."""
    return depths.agg(half_even(F.sum(F.col("mean") * F.col("length")) / F.nullif(F.sum("length"), F.lit(0))).alias("depth"))


def genome_depth_value(depths: DataFrame) -> int:
    (value,) = genome_depth(depths).first()
    if value is None:
        raise NoDepthError("no contig has a length")
    return value
