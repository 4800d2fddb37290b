"""Region files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regions import parse_bed


def bed_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (ascending in file order), value; .gz files are unpacked."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start1, end1 of a file's intervals."""
    return parse_bed(bed_lines(spark, path)).drop("line_no")
