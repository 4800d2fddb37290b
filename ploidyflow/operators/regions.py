"""Target regions: BED rows, merging, containment, contig lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import joined_parts, merged_in_parts

#: Bases of a bin, by which positions and intervals meet.
BIN = 1 << 14


#: Regions that a reader is given at most; with more it reads all.
MOST_REGIONS = 100_000


class BedError(ValueError):
    """A BED row that cannot be read."""


def parse_bed(lines: DataFrame) -> DataFrame:
    """line_no, chrom, start1, end1 (1-based, half open) of BED rows: columns line_no, value.

    Blank rows and those that begin with track, browser or # are no regions, nor are
    empty intervals. A row of fewer than three columns, or whose start or end is no whole number, is an error when it is read.
    """
    # generated, so that what makes a row's text and its columns runs once a row, however often they are named below
    once = lines.select("line_no", F.explode(F.array(F.struct("value", F.split("value", "\t").alias("part")))).alias("x"))
    text, part = F.col("x.value"), F.col("x.part")
    whole = once.where(~text.rlike("^(track|browser|#)") & (F.trim(text) != ""))

    def number(k: int) -> Column:
        value = F.get(part, F.lit(k))
        whole_number = F.trim(value).try_cast("bigint")
        few = F.raise_error(F.concat(F.lit("a BED row has fewer than 3 columns: "), text))
        wrong = F.raise_error(F.concat(F.lit("a BED row has a bound that is no whole number: "), value))
        return F.when(F.size(part) < 3, few).when(whole_number.isNull(), wrong).otherwise(whole_number) + 1

    shifted = whole.select("line_no", F.get(part, F.lit(0)).alias("chrom"), number(1).alias("start1"), number(2).alias("end1"))
    return shifted.where("end1 > start1")


def bed_contigs(lines: DataFrame) -> DataFrame:
    """chrom, ord: contigs in the order in which a BED file first names them."""
    kept = lines.where(~F.col("value").rlike("^(track|browser|#)") & (F.trim("value") != ""))
    first = kept.select(F.split("value", "\t")[0].alias("chrom"), "line_no").groupBy("chrom").agg(F.min("line_no").alias("first"))
    return first.select("chrom", F.row_number().over(Window.orderBy("first")).alias("ord"))  # as many rows as contigs


def merge_intervals(regions: DataFrame) -> DataFrame:
    """chrom, start1, end1: disjoint intervals; touching ones are one.

    Intervals are dealt by range and merged in each part, whose reach is then carried to those after it, so no contig is one task.
    """
    return joined_parts(merged_in_parts(regions))


def wide_regions(regions: DataFrame, margin: int = BIN, most: int = MOST_REGIONS) -> list[tuple[str, int, int]] | None:
    """Merged regions, wider by a margin on both sides, for a reader; None if there are more than so many."""
    wide = regions.select("chrom", F.greatest(F.col("start1") - margin, F.lit(1)).alias("start1"), (F.col("end1") + margin).alias("end1"))
    rows = merge_intervals(wide).limit(most + 1).collect()
    return [(r.chrom, r.start1, r.end1) for r in rows] if len(rows) <= most else None


def within_regions(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """Sites whose position lies in a region; each once.

    Intervals are dealt into bins and met by an equi join, so neither side is broadcast
    or crossed, whatever its size.
    """
    bins = merge_intervals(regions).select("chrom", "start1", "end1", F.explode(F.sequence(F.floor(F.col("start1") / BIN), F.floor((F.col("end1") - 1) / BIN))).alias("_bin"))
    return sites.withColumn("_bin", F.floor(F.col("pos") / BIN)).alias("s").join(
        bins.alias("r"), (F.col("s.chrom") == F.col("r.chrom")) & (F.col("s._bin") == F.col("r._bin")) & (F.col("s.pos") >= F.col("r.start1")) & (F.col("s.pos") < F.col("r.end1")), "left_semi"
    ).drop("_bin")


def invalid_contigs(asked: DataFrame, contigs: DataFrame) -> DataFrame:
    """chrom of those asked for that the reference doesn't have."""
    return asked.select("chrom").distinct().join(contigs.select("chrom"), "chrom", "left_anti")
