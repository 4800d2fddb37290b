"""Variant records and the VCF file."""

from __future__ import annotations

import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import allele_fraction, genotype, plain_number, qual
from ..sources import blocks
from ..store import mounted

# Fixed values of the file's header.
HEADER = (
    "##fileformat=VCFv4.2",
    '##FILTER=<ID=PASS,Description="All filters passed">',
    '##FILTER=<ID=RefCall,Description="Genotyping model thinks this site is reference.">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype Quality">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read depth">',
    '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Allelic depths for the ref and alt alleles in the order listed">',
    '##FORMAT=<ID=AF,Number=A,Type=Float,Description="Allele Frequency, for each ALT allele, in the same order as listed">',
)
COLUMNS_LINE = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"


def record_fields(scored: DataFrame, ploidy: int) -> DataFrame:
    """scored with qual, gq, gt, dp, ad, af, filter and shown_alt."""
    label = F.col("pred_label")
    return (
        scored.withColumn("qual", qual(F.col("pred_prob")))
        .withColumn("gq", F.col("qual").cast("int"))
        .withColumn("gt", genotype(label, ploidy))
        .withColumn("dp", F.greatest("rd", F.lit(1)))
        .withColumn("ad", F.concat_ws(",", F.col("ref_num").cast("string"), F.col("alt_num").cast("string")))
        .withColumn("af", allele_fraction(F.col("alt_num"), F.col("dp")))
        .withColumn("shown_alt", F.when(label == 0, ".").otherwise(F.col("alt")))
        .withColumn("filter", F.when(label == 0, "RefCall").otherwise("PASS"))
    )


def record_line() -> Column:
    sample = F.concat_ws(":", "gt", F.col("gq").cast("string"), F.col("dp").cast("string"), "ad", plain_number(F.col("af")))
    return F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "shown_alt", plain_number(F.col("qual"), 2), "filter", F.lit("."), F.lit("GT:GQ:DP:AD:AF"), sample)


def record_lines(scored: DataFrame, ploidy: int) -> DataFrame:
    """chrom, pos, line of every scored site."""
    return record_fields(scored, ploidy).select("chrom", "pos", record_line().alias("line"))


def header_lines(contigs: DataFrame) -> DataFrame:
    """section, chrom_ord, line: the fixed head, a line for each contig in order of ord, the column names."""
    spark = contigs.sparkSession
    fixed = spark.createDataFrame([(0, k, x) for k, x in enumerate(HEADER)], "section int, chrom_ord int, line string")
    own = contigs.select(F.lit(1).alias("section"), F.col("ord").cast("int").alias("chrom_ord"), F.concat(F.lit("##contig=<ID="), "chrom", F.lit(",length="), F.col("length").cast("string"), F.lit(">")).alias("line"))
    names = spark.createDataFrame([(2, 0, COLUMNS_LINE)], "section int, chrom_ord int, line string")
    return fixed.union(own).union(names)


def vcf_lines(scored: DataFrame, contigs: DataFrame, ploidy: int) -> DataFrame:
    """section, chrom_ord, pos, line: the whole file's lines, to be put in that order by the sink."""
    head = header_lines(contigs).select("section", "chrom_ord", F.lit(0).cast("bigint").alias("pos"), "line")
    body = record_lines(scored, ploidy).join(contigs.select("chrom", "ord"), "chrom")
    return head.union(body.select(F.lit(3).alias("section"), F.col("ord").cast("int").alias("chrom_ord"), "pos", "line"))


def in_order(lines: DataFrame) -> DataFrame:
    """Lines in file order, by range partitions: no task sorts all. chrom, begin and end (0-based, half open) are those of records, null of others."""
    ordered = lines.orderBy("section", "chrom_ord", "pos")
    record, begin = F.col("section") == 3, F.col("pos") - 1
    ref = F.get(F.split("line", "\t", 5), F.lit(3))
    return ordered.select("line", F.when(record, F.substring_index("line", "\t", 1)).alias("chrom"), F.when(record, begin).alias("begin"), F.when(record, begin + F.greatest(F.length(ref), F.lit(1))).alias("end"))


def write_vcf_parts(lines: DataFrame, folder: str, longest: int = 1 << 29) -> None:
    """A folder of block-compressed parts in file order, each with its index: .tbi, or .csi if a contig is longer than that can hold."""
    blocks.write_parts(in_order(lines), folder, blocks.depth_for(longest))


def write_vcf(lines: DataFrame, path: str, longest: int = 1 << 29) -> None:
    """One block-compressed file and its index, in a file system that executors share.

    Tasks write parts and copy them to their places in the file; the driver sees sizes and indexes alone.
    longest: of the contigs' lengths; beyond 2**29 the index is a .csi file.
    """
    if mounted(path) is None:
        raise ValueError(f"{path} is in no mounted file system: write parts there")
    parts = f"{path}.{uuid.uuid4().hex}"
    try:
        write_vcf_parts(lines, parts, longest)
        blocks.joined(lines.sparkSession, parts, path, blocks.depth_for(longest))
    finally:
        shutil.rmtree(mounted(parts), ignore_errors=True)


def write_tabix(path: str) -> str:
    """Writes the index of a block-compressed VCF file beside it and returns its path: .tbi, or .csi if positions go beyond 2**29."""
    return blocks.index_of(SparkSession.active(), path)


def region_lines(spark: SparkSession, path: str, chrom: str, first: int, last: int) -> DataFrame:
    """line of a contig's records whose position lies between first and last (1-based): only blocks that the index names are read."""
    blocks.register(spark)
    lines = spark.read.format("bgzf").option("chrom", chrom).option("first", first).option("last", last).load(path)
    part = F.split("line", "\t", 3)
    return lines.where(~F.startswith("line", F.lit("#")) & (F.get(part, F.lit(0)) == chrom) & F.get(part, F.lit(1)).cast("bigint").between(first, last)).select("line")
