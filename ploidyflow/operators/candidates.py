"""Candidate variant sites: the commonest alternative allele of each position, and its tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import deletion, indel_length, indel_sequence, insertion, snp_allele, soft_masked
from .pileup import token_counts

KINDS = ("SNP", "INS", "DEL")
#: Bases of a slice of the reference, by which positions meet blocks of it.
SLICE = 64


def bases_at(columns: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds base, the reference's at each position; positions that it doesn't have are left out.

    reference: chrom, pos, base, a row a base; or chrom, start, seq, a row a block, of
    which slices meet the positions, so the genome isn't a row a base in any exchange.
    """
    if "base" in reference.columns:
        return columns.join(reference.select("chrom", "pos", "base"), ["chrom", "pos"])
    first, last = F.floor(F.col("start") / SLICE), F.floor((F.col("start") + F.length("seq") - 1) / SLICE)
    begin = lambda k: F.greatest(k * SLICE, F.col("start"))
    cut = lambda k: F.struct(k.alias("slice"), begin(k).alias("begin"), F.substr("seq", (begin(k) - F.col("start") + 1).cast("int"), ((k + 1) * SLICE - begin(k)).cast("int")).alias("bases"))
    slices = reference.where("seq <> ''").select("chrom", F.inline(F.transform(F.sequence(first, last), cut)))
    met = columns.withColumn("slice", F.floor(F.col("pos") / SLICE)).join(slices, ["chrom", "slice"])
    here = (F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("begin") + F.length("bases"))
    return met.where(here).withColumn("base", F.substr("bases", (F.col("pos") - F.col("begin") + 1).cast("int"), F.lit(1))).drop("slice", "begin", "bases")


def with_reference(columns: DataFrame, reference: DataFrame, uppercase: bool = False) -> DataFrame:
    """Adds ref: the base if it is an upper-case letter, else `*` (soft-masked or ambiguous)."""
    return bases_at(columns, reference).withColumn("ref", soft_masked(F.col("base"), uppercase)).drop("base")


def allele_counts(tokens: DataFrame) -> DataFrame:
    """chrom, pos, ref, kind, allele, n: one token may show a base and carry an indel, and counts as both.

    tokens: chrom, pos, token, n, ref.
    """
    token, ref = F.col("token"), F.col("ref")
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), allele.alias("allele")) for kind, allele in zip(KINDS, (snp_allele(token, ref), insertion(token), deletion(token)), strict=True)])
    spread = tokens.select("chrom", "pos", "ref", "n", F.explode(F.filter(found, lambda x: x["allele"].isNotNull())).alias("x"))
    return spread.groupBy("chrom", "pos", "ref", F.col("x.kind").alias("kind"), F.col("x.allele").alias("allele")).agg(F.sum("n").cast("int").alias("n"))


def top_alleles(counts: DataFrame, by: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """by, and for each kind its commonest allele and count (snp, snp_n, ins, ins_n, del, del_n); of equal counts the smallest allele."""
    best = [F.min(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("minus"), "allele"))).alias(kind) for kind in KINDS]
    out = counts.groupBy(*by).agg(*best)
    columns = [c for kind in KINDS for c in (F.col(f"{kind}.allele").alias(kind.lower()), F.coalesce(-F.col(f"{kind}.minus"), F.lit(0)).alias(f"{kind.lower()}_n"))]
    return out.select(*by, *columns)


def chosen_kind(snp: Column, ins: Column, dele: Column) -> Column:
    """SNP before insertion before deletion where counts are equal."""
    return F.when((snp >= ins) & (snp >= dele), "SNP").when((ins >= snp) & (ins >= dele), "INS").otherwise("DEL")


def site_table(obs: DataFrame, ref_bases: DataFrame, uppercase: bool = False) -> DataFrame:
    """A row for each covered position with the reference: ref, rd, ref_num and the top allele of each kind."""
    tokens = with_reference(token_counts(obs), ref_bases, uppercase)
    columns = tokens.groupBy("chrom", "pos", "ref").agg(F.sum("n").cast("int").alias("rd"), F.sum(F.when(F.col("token") == F.col("ref"), F.col("n")).otherwise(0)).cast("int").alias("ref_num"))
    tops = top_alleles(allele_counts(tokens))
    return columns.join(tops, ["chrom", "pos"], "left").na.fill(0, ["snp_n", "ins_n", "del_n"])


def deletion_spans(sites: DataFrame, ref_bases: DataFrame, uppercase: bool = False) -> DataFrame:
    """chrom, pos, span: the reference from a deletion's base to its last deleted one; positions without a base are left out.

    sites: chrom, pos, n (deleted bases).
    """
    wanted = sites.select("chrom", F.col("pos").alias("site"), F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n"))).alias("pos"))
    bases = bases_at(wanted, ref_bases).withColumn("base", soft_masked(F.col("base"), uppercase))
    spans = bases.groupBy("chrom", "site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("span"))
    return spans.select("chrom", F.col("site").alias("pos"), "span")


def candidate_sites(
    obs: DataFrame, ref_bases: DataFrame, min_depth: Column | int, min_af: float = 0.1, max_indel: int = 20, uppercase: bool = False, acgt_only: bool = False
) -> DataFrame:
    """Sites whose commonest alternative allele is frequent enough.

    A site needs an upper-case reference base, a depth of min_depth and a share of
    min_af. A site whose chosen indel is longer than max_indel is dropped, and
    doesn't fall back to a SNP. acgt_only leaves SNPs to other letters out.
    """
    least = F.lit(min_depth) if isinstance(min_depth, int) else min_depth
    sites = site_table(obs, ref_bases, uppercase).where((F.col("ref") != "*") & (F.col("rd") >= least))
    sites = sites.withColumn("alt_num", F.greatest("snp_n", "ins_n", "del_n")).where((F.col("alt_num") > 0) & (F.col("alt_num") / F.col("rd") >= min_af))
    sites = sites.withColumn("kind", chosen_kind(F.col("snp_n"), F.col("ins_n"), F.col("del_n")))
    ins_seq, del_n = indel_sequence(F.col("ins")), indel_length(F.col("del"))
    sites = sites.where((F.col("kind") == "SNP") | ((F.col("kind") == "INS") & (F.length(ins_seq) <= max_indel)) | ((F.col("kind") == "DEL") & (del_n <= max_indel)))
    if acgt_only:
        sites = sites.where((F.col("kind") != "SNP") | F.col("snp").isin("A", "C", "G", "T"))
    spans = deletion_spans(sites.where("kind = 'DEL'").select("chrom", "pos", del_n.alias("n")), ref_bases, uppercase)
    whole = sites.join(spans, ["chrom", "pos"], "left")
    ref = F.when(F.col("kind") == "DEL", F.col("span")).otherwise(F.col("ref"))
    alt = F.when(F.col("kind") == "SNP", F.col("snp")).when(F.col("kind") == "INS", F.concat("ref", ins_seq)).otherwise(F.col("ref"))
    return whole.select("chrom", "pos", ref.alias("ref"), alt.alias("alt"), "kind", "rd", "ref_num", "alt_num")
