"""Features of pileup columns and windows of columns.

A column has 30 numbers: genome depth, reference code, then 14 of the reverse strand
and the same 14 of the forward strand: counts of A, C, G, T; of the top insertion,
of the top deletion, of `*`; and sums of mapping quality of A, C, G, T, of tokens
with an insertion of the top's length, with a deletion of the top's length, and
of tokens with a `*`. Each column is encoded once, from counts by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import BASES, base_code, deletion, first_letter, indel_length, insertion, strand
from .candidates import top_alleles, with_reference

#: Names of a strand's numbers in order.
STRAND_FEATURES = ("a", "c", "g", "t", "is1", "ds1", "dr", "mq_a", "mq_c", "mq_g", "mq_t", "mq_ins", "mq_del", "mq_star")
#: 1: reverse, which comes first.
STRANDS = ((1, "rev"), (0, "fwd"))
FEATURES = ("depth", "ref_code", *(f"{side}_{x}" for _, side in STRANDS for x in STRAND_FEATURES))
#: Positions of a bin in which ordinals are counted on their own.
ORDINAL_BIN = 1 << 20
#: Covered columns of a bin in which frames are walked.
WINDOW_BIN = 1 << 12


def strand_tokens(obs: DataFrame) -> DataFrame:
    """chrom, pos, strand, token (upper case), n, mq (sum of mapping qualities)."""
    return obs.where("pos >= 2").groupBy("chrom", "pos", strand(F.col("flag")).alias("strand"), F.upper("token").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.sum("mapq").alias("mq"))


def strand_tops(tokens: DataFrame) -> DataFrame:
    """chrom, pos, strand, ins, ins_n, del, del_n: the top indels of each strand."""
    token = F.col("token")
    found = F.array(F.struct(F.lit("INS").alias("kind"), insertion(token).alias("allele")), F.struct(F.lit("DEL").alias("kind"), deletion(token).alias("allele")))
    spread = tokens.select("chrom", "pos", "strand", "n", F.explode(F.filter(found, lambda x: x["allele"].isNotNull())).alias("x"))
    counts = spread.groupBy("chrom", "pos", "strand", F.col("x.kind").alias("kind"), F.col("x.allele").alias("allele")).agg(F.sum("n").cast("int").alias("n"))
    return top_alleles(counts, ("chrom", "pos", "strand")).drop("snp", "snp_n")


def _strand_sums() -> list[Column]:
    token, n, mq = F.col("token"), F.col("n"), F.col("mq")
    star, letter = F.contains(token, F.lit("*")), first_letter(token)
    real = ~star & letter.isin(*BASES)
    # any sequence of a length that begins with the top's digits matches
    ins = real & F.col("ins").isNotNull() & F.contains(token, F.concat(F.lit("+"), indel_length(F.col("ins")).cast("string")))
    dele = real & F.col("del").isNotNull() & F.contains(token, F.concat(F.lit("-"), indel_length(F.col("del")).cast("string")))
    total = lambda cond, value: F.sum(F.when(cond, value).otherwise(0)).cast("bigint")
    return [
        *[total(letter == b, n).alias(b.lower()) for b in BASES],
        F.max(F.coalesce("ins_n", F.lit(0))).cast("bigint").alias("is1"),
        F.max(F.coalesce("del_n", F.lit(0))).cast("bigint").alias("ds1"),
        total(token == "*", n).alias("dr"),
        *[total(real & (letter == b), mq).alias(f"mq_{b.lower()}") for b in BASES],
        total(ins, mq).alias("mq_ins"),
        total(dele, mq).alias("mq_del"),
        total(star, mq).alias("mq_star"),
    ]


def strand_features(obs: DataFrame) -> DataFrame:
    """chrom, pos, strand and its 14 numbers."""
    tokens = strand_tokens(obs)
    with_tops = tokens.join(strand_tops(tokens), ["chrom", "pos", "strand"], "left")
    return with_tops.groupBy("chrom", "pos", "strand").agg(*_strand_sums())


def column_features(obs: DataFrame, ref_bases: DataFrame, depth: Column | int, uppercase: bool = False) -> DataFrame:
    """chrom, pos and the 30 numbers of every covered position."""
    sides = strand_features(obs)
    flat = sides.groupBy("chrom", "pos").agg(*[F.sum(F.when(F.col("strand") == s, F.col(x)).otherwise(0)).alias(f"{side}_{x}") for s, side in STRANDS for x in STRAND_FEATURES])
    out = with_reference(flat, ref_bases, uppercase).withColumn("ref_code", base_code(F.col("ref"))).withColumn("depth", F.lit(depth) if isinstance(depth, int) else depth)
    return out.select("chrom", "pos", *FEATURES)


def with_ordinals(columns: DataFrame, ordinal_bin: int = ORDINAL_BIN) -> DataFrame:
    """Adds ord, the number of a column among its contig's covered ones, and n_cols, how many there are.

    Numbers are counted in bins side by side and the bins' totals are summed, so no
    contig is one task.
    """
    binned = columns.withColumn("_bin", F.floor(F.col("pos") / ordinal_bin))
    totals = binned.groupBy("chrom", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    each = Window.partitionBy("chrom").orderBy("_bin")
    before = totals.select("chrom", "_bin", F.coalesce(F.sum("_n").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("chrom")).alias("n_cols"))
    own = F.row_number().over(Window.partitionBy("chrom", "_bin").orderBy("pos"))
    return binned.withColumn("_own", own).join(before, ["chrom", "_bin"]).withColumn("ord", F.col("_before") + F.col("_own")).drop("_bin", "_own", "_before")


def full_windows(numbered: DataFrame, window: int) -> DataFrame:
    """Columns with window + 1 covered ones before and window after."""
    return numbered.where((F.col("ord") >= window + 2) & (F.col("ord") <= F.col("n_cols") - window))


def feature_array() -> Column:
    return F.array(*[F.col(x).cast("float") for x in FEATURES])


def window_tensors(numbered: DataFrame, sites: DataFrame, window: int, ordinal_join: bool = False, window_bin: int = WINDOW_BIN) -> DataFrame:
    """sites with x: the features of 2 * window + 1 covered columns around each, as one flat array.

    Gaps in coverage are closed, not padded. Sites without a full window are left out.
    numbered: column_features() with ordinals. By default columns are dealt into bins of
    their numbers, with a halo of the window's width, bins without a site are left out, and a frame is walked
    along each of the others; ordinal_join meets neighbours by their number, for few sites.
    """
    feats = numbered.select("chrom", "pos", "ord", "n_cols", feature_array().alias("feat"))
    if not ordinal_join:
        own = F.floor(F.col("ord") / window_bin)
        marked = feats.join(sites.select("chrom", "pos", F.struct(*sites.columns).alias("site")), ["chrom", "pos"], "left")
        centre = F.col("site").isNotNull() & (F.col("ord") >= window + 2) & (F.col("ord") <= F.col("n_cols") - window)
        reach = F.sequence(F.floor(F.greatest(F.col("ord") - window, F.lit(0)) / window_bin), F.floor((F.col("ord") + window) / window_bin))
        dealt = marked.select("chrom", "ord", "feat", F.when(centre, F.col("site")).alias("site"), own.alias("home"), F.explode(reach).alias("bin"))
        dealt = dealt.withColumn("site", F.when(F.col("home") == F.col("bin"), F.col("site")))
        bins = Window.partitionBy("chrom", "bin")
        asked = dealt.withColumn("asked", F.max(F.col("site").isNotNull()).over(bins)).where("asked")
        frame = bins.orderBy("ord").rowsBetween(-window, window)
        return asked.withColumn("x", F.collect_list("feat").over(frame)).where("site is not null").select("site.*", F.flatten("x").alias("x"))
    centres = full_windows(feats, window).join(sites.select("chrom", "pos"), ["chrom", "pos"], "left_semi")
    wanted = centres.select("chrom", "pos", F.explode(F.sequence(F.col("ord") - window, F.col("ord") + window)).alias("ord"))
    met = wanted.join(feats.select("chrom", "ord", "feat"), ["chrom", "ord"])
    tensors = met.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("ord", "feat"))).alias("all"))
    return sites.join(tensors.select("chrom", "pos", F.flatten(F.transform("all", lambda v: v["feat"])).alias("x")), ["chrom", "pos"])
