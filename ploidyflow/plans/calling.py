"""From reads to VCF lines. Reads are swept bin by bin once; with a model what that gives is written, and windows are made of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CallerConfig
from ..operators.admission import admitted
from ..operators.depth import contig_depth, genome_depth_value
from ..operators.encode import window_tensors
from ..operators.reads import read_filter, rename_reads
from ..operators.scoring import batch_scores, binomial_scores
from ..operators.sweep import featured_columns, numbered, read_tokens, sites_of, swept, windows_of
from ..operators.vcf import vcf_lines
from ..schema import SCORED
from ..store import written

Scorer = Callable[[DataFrame], DataFrame]


def scored_sites(reads: DataFrame, ref_bases: DataFrame, contigs: DataFrame, config: CallerConfig, regions: DataFrame | None = None, make_predictor=None, mean=None, std=None, near: DataFrame | None = None) -> DataFrame:
    """Candidate sites with pred_prob and pred_label.

    With a predictor sites have a full window of covered columns and are scored by
    the model; without one the binomial scorer takes every candidate. Depth is over
    all contigs, also when only some are called. Contigs or regions without reads or
    candidates give no rows. near: the reads that reach the regions, if those can be read alone; without a predictor
    columns are made of them. Windows close gaps in coverage, however wide, so with one all reads are taken.
    """
    config = config.checked()
    usable = rename_reads(read_filter(reads, config.min_mapq))
    depth = genome_depth_value(contig_depth(usable, contigs))
    if near is not None and make_predictor is None:
        usable = rename_reads(read_filter(near, config.min_mapq))
    if config.contigs:
        usable = usable.where(F.col("chrom").isin(*dict.fromkeys(config.contigs)))
    tokens = read_tokens(admitted(usable, config.max_depth))
    rules = {"depth": depth, "least": max(round(depth / config.ploidy), config.rd_floor), "min_af": config.min_af, "max_indel": config.max_indel, "uppercase": config.uppercase_ref, "acgt_only": config.acgt_only, "regions": regions}
    if make_predictor is None:
        return binomial_scores(sites_of(swept(tokens, ref_bases, **rules)), config.ploidy)
    if config.ordinal_join:
        columns = written(swept(tokens, ref_bases, every=True, **rules), "columns")
        encoded = window_tensors(featured_columns(numbered(columns)), sites_of(columns), config.window, ordinal_join=True)
    else:
        encoded = windows_of(written(swept(tokens, ref_bases, window=config.window, **rules), "columns"), config.window)
    return batch_scores(encoded, make_predictor, config.window, mean, std, config.batch_size)


def write_scored(scored: DataFrame, path: str) -> None:
    """Scored sites as Parquet, a folder a contig, zstd."""
    scored.withColumn("pred_prob", F.col("pred_prob").cast("double")).write.partitionBy("chrom").option("compression", "zstd").mode("overwrite").parquet(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """What write_scored() wrote."""
    return spark.read.schema(SCORED).parquet(path)


def call_variants(reads: DataFrame, ref_bases: DataFrame, contigs: DataFrame, config: CallerConfig, regions: DataFrame | None = None, make_predictor=None, mean=None, std=None, scored_to: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """section, chrom_ord, pos, line of the VCF file: header, then sites by contig and position.

    ref_bases is a row a base or a row a block (see bases_at). scored_to names a folder that keeps the scored sites.
    """
    scored = scored_sites(reads, ref_bases, contigs, config, regions, make_predictor, mean, std, near)
    if scored_to:
        write_scored(scored, scored_to)
        scored = read_scored(reads.sparkSession, scored_to)
    chosen = contigs.where(F.col("chrom").isin(*dict.fromkeys(config.contigs))) if config.contigs else contigs
    return vcf_lines(scored, chosen, config.ploidy)
