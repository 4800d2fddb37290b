"""Expressions on CIGAR texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ref_span(cigar: Column) -> Column:
    """Reference bases that an alignment covers: its M, D, N, = and X operations."""
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda total, x: total + x.cast("bigint"))
