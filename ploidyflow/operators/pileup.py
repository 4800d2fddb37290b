"""From alignments to pileup observations and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _operations(cigar: Column) -> Column:
    """(length, op) of every operation."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def indel_suffix(op: Column, n: Column, inserted: Column) -> Column:
    """What the base before an insertion or deletion carries; kept apart, as readers differ on it after a deleted base."""
    return F.when(op == "I", F.concat(F.lit("+"), n.cast("string"), inserted)).when(op == "D", F.concat(F.lit("-"), n.cast("string"), F.repeat(F.lit("N"), n))).otherwise("")


def observations(reads: DataFrame) -> DataFrame:
    """chrom, pos, qname, flag, mapq, token: what each read shows at each position it covers.

    Offsets in the reference and in the read run along the operations, and each
    match, deletion or skip is exploded to its positions. M, = and X show bases, D
    `*`, N `>` or `<` by strand; S takes read bases only, H and P nothing. The last
    base before an insertion or deletion carries it as a suffix.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("q"), F.array().cast("array<struct<op:string,n:int,r:bigint,q:bigint>>").alias("out"))

    def step(acc, x):
        takes_ref = x["op"].isin("M", "D", "N", "=", "X").cast("bigint")
        takes_read = x["op"].isin("M", "I", "S", "=", "X").cast("bigint")
        here = F.struct(x["op"].alias("op"), x["n"].alias("n"), acc["r"].alias("r"), acc["q"].alias("q"))
        return F.struct((acc["r"] + takes_ref * x["n"]).alias("r"), (acc["q"] + takes_read * x["n"]).alias("q"), F.concat(acc["out"], F.array(here)).alias("out"))

    laid = reads.where("cigar is not null and cigar <> '*'").withColumn("ops", F.aggregate(_operations(F.col("cigar")), start, step)["out"])
    one = laid.select("chrom", "pos", "qname", "flag", "mapq", "seq", "ops", F.posexplode("ops").alias("k", "op"))
    nxt = F.try_element_at("ops", F.col("k") + 2)
    suffix = F.coalesce(indel_suffix(nxt["op"], nxt["n"], F.substring(F.col("seq"), (nxt["q"] + 1).cast("int"), nxt["n"])), F.lit(""))
    spread = one.where(F.col("op.op").isin("M", "D", "N", "=", "X") & (F.col("op.n") > 0)).select(
        "chrom", "pos", "qname", "flag", "mapq", "seq", "op", suffix.alias("suffix"), F.explode(F.sequence(F.lit(0), F.col("op.n") - 1)).alias("i")
    )
    shown = (
        F.when(F.col("op.op") == "D", F.lit("*"))
        .when(F.col("op.op") == "N", F.when(F.col("flag").bitwiseAND(F.lit(16)) == 0, ">").otherwise("<"))
        .otherwise(F.substring("seq", (F.col("op.q") + F.col("i") + 1).cast("int"), F.lit(1)))
    )
    token = F.concat(shown, F.when((F.col("i") == F.col("op.n") - 1) & (F.col("op.op") != "N"), F.col("suffix")).otherwise(""))
    return spread.select("chrom", (F.col("pos") + F.col("op.r") + F.col("i")).alias("pos"), "qname", "flag", "mapq", token.alias("token"))


def depth_capped(obs: DataFrame, most: int | None) -> DataFrame:
    """At most so many observations a position, those of the smallest names; all if most is None."""
    if most is None:
        return obs
    rank = Window.partitionBy("chrom", "pos").orderBy("qname", "flag", "token")
    return obs.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= most).drop("_rank")


def token_counts(obs: DataFrame) -> DataFrame:
    """chrom, pos, token (upper case), n. All that follows is made from these few rows a position.

    Position 1 is never a column.
    """
    return obs.where("pos >= 2").groupBy("chrom", "pos", F.upper("token").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def pileup_columns(obs: DataFrame, ref_bases: DataFrame) -> DataFrame:
    """chrom, pos, ref (raw base), rd of every covered position."""
    return token_counts(obs).groupBy("chrom", "pos").agg(F.sum("n").cast("int").alias("rd")).join(ref_bases.select("chrom", "pos", F.col("base").alias("ref")), ["chrom", "pos"])
