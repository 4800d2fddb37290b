"""Streams of reads.

All inputs of variant calling are bounded, so there is no stateful operator here.
The read filter, renaming and strand are stateless and take a streaming DataFrame
as it is; filtered_reads() is the one step in front of a sink.
"""

from pyspark.sql import DataFrame

from ..operators.reads import read_filter, rename_reads


def filtered_reads(reads: DataFrame, min_mapq: int = 5) -> DataFrame:
    """Usable reads of a stream (or a table), renamed, in the order they come."""
    return rename_reads(read_filter(reads, min_mapq))
