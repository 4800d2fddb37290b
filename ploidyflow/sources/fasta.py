"""Reference sequence and its index, read by Spark's text reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CONTIGS

FAI = "chrom string, length bigint, offset bigint, line_bases int, line_width int"


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length, ord, offset, line_bases, line_width of an index file, in file order."""
    rows = spark.read.csv(path, sep="\t", schema=FAI, quote="")
    order = Window.orderBy(F.col("offset"))  # a row a contig
    return rows.select("chrom", "length", F.row_number().over(order).alias("ord"), "offset", "line_bases", "line_width")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, split (where the line's part of the file begins), line (its number there)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return lines


def fasta_blocks(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start (1-based position of its first base), seq of every sequence line.

    Lines are numbered by the part of the file they stand in; running sums over
    parts give each line its contig and position, and no contig is one row.
    """
    lines = _numbered_lines(spark, path)
    name = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S*)", 1))
    sized = lines.select("split", "line", "value", name.alias("name"), F.when(name.isNull(), F.length(F.trim("value"))).otherwise(0).alias("n"))
    inside = Window.partitionBy("split").orderBy("line")
    marked = sized.withColumn("own", F.last("name", ignorenulls=True).over(inside)).withColumn("upto", F.sum("n").over(inside) - F.col("n"))
    marked = marked.withColumn("headed", F.max(F.when(F.col("name").isNotNull(), F.col("upto"))).over(inside))
    # of each part: the contig it ends in and the bases after that contig's header; a row a part
    ends = sized.withColumn("upto", F.sum("n").over(inside)).groupBy("split").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("line"))).alias("last"), F.max("upto").alias("total"), F.max(F.when(F.col("name").isNotNull(), F.col("upto"))).alias("header")
    )
    parts = Window.orderBy("split")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("passed", F.coalesce(F.sum("total").over(before), F.lit(0)))
    ends = ends.withColumn("contig", F.last("last", ignorenulls=True).over(before)).withColumn("begun", F.coalesce(F.max(F.when(F.col("last").isNotNull(), F.col("passed") + F.col("header"))).over(before), F.lit(0)))
    met = marked.where("name is null and n > 0").join(ends.select("split", "contig", "begun", "passed"), "split")
    start = F.when(F.col("own").isNotNull(), F.col("upto") - F.col("headed")).otherwise(F.col("passed") + F.col("upto") - F.col("begun")) + 1
    return met.select(F.coalesce("own", "contig").alias("chrom"), start.cast("bigint").alias("start"), F.trim("value").alias("seq"))


def fasta_bases(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, base (case kept) of the whole file."""
    blocks = fasta_blocks(spark, path)
    return blocks.select("chrom", "start", F.posexplode(F.split("seq", "")).alias("i", "base")).where("base <> ''").select("chrom", (F.col("start") + F.col("i")).alias("pos"), "base")


def fasta_contigs(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length, ord of the file's contigs, without an index."""
    lines = _numbered_lines(spark, path).where(F.col("value").startswith(">")).select(F.regexp_extract("value", r"^>(\S*)", 1).alias("chrom"), "split", "line")
    order = lines.select("chrom", F.row_number().over(Window.orderBy("split", "line")).alias("ord"))  # a row a contig
    sizes = fasta_blocks(spark, path).groupBy("chrom").agg(F.sum(F.length("seq")).cast("bigint").alias("length"))
    return order.join(sizes, "chrom", "left").select("chrom", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"), "ord").to(_schema(spark, CONTIGS))


def _schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def fai_lines(spark: SparkSession, path: str) -> DataFrame:
    """The five index columns of a file of Unix lines, computed from its text."""
    lines = _numbered_lines(spark, path)
    blocks = fasta_blocks(spark, path)
    first = blocks.groupBy("chrom").agg(F.max(F.length("seq")).alias("line_bases"), F.sum(F.length("seq")).cast("bigint").alias("length"))
    upto = F.sum(F.octet_length("value") + 1).over(Window.partitionBy("split").orderBy("line"))
    sizes = lines.groupBy("split").agg(F.sum(F.octet_length("value") + 1).alias("n"))
    passed = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part of the file
    heads = lines.withColumn("upto", upto).where(F.col("value").startswith(">")).join(sizes.select("split", passed.alias("passed")), "split")
    return heads.withColumn("offset", F.col("upto") + F.col("passed")).select(F.regexp_extract("value", r"^>(\S*)", 1).alias("chrom"), F.col("offset").cast("bigint").alias("offset")).join(first, "chrom").select("chrom", "length", "offset", "line_bases", (F.col("line_bases") + 1).alias("line_width"))
