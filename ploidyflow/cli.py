"""Command line: reads and a reference in, a VCF file out."""

from __future__ import annotations

import argparse
import json
import logging
import os
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import SPECIES, CallerConfig, ConfigError, model_files, model_folder, parallelism
from .operators.regions import bed_contigs, invalid_contigs, wide_regions
from .operators.scoring import model_predictor, read_statistics
from .operators.vcf import write_vcf
from .plans.calling import call_variants
from .sources import bam, sam
from .sources.bed import bed_lines, read_bed
from .sources.fasta import fasta_blocks, fasta_contigs, read_fai

log = logging.getLogger("ploidyflow")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ploidyflow", description="Calls SNPs and short indels in polyploids.")
    p.add_argument("-r", "--ref", required=True, help="reference FASTA")
    p.add_argument("-b", "--bam", required=True, help="alignments, BAM or SAM text")
    p.add_argument("-p", "--ploidy", required=True, type=int, choices=(4, 6))
    p.add_argument("-c", "--chroms", nargs="+", help="contigs to call")
    p.add_argument("-o", "--output", default="output.vcf")
    p.add_argument("-l", "--bed", help="regions to call; --chroms is ignored then")
    p.add_argument("-t", "--cpus", type=int, default=24, help="tasks at once; -1 takes what there is")
    p.add_argument("-s", "--species", choices=tuple(SPECIES))
    p.add_argument("-m", "--mode", default="speed", choices=("speed", "performance"))
    p.add_argument("--models", help="folder of model folders; the one of species and mode is taken, with its window and statistics")
    p.add_argument("--min_af", type=float, default=0.10)
    p.add_argument("--rd_floor", type=int, default=10)
    p.add_argument("--model", help="model of the windows, an ONNX file or a saved network's folder; without one the binomial scorer calls")
    p.add_argument("--statistics", help="mean and std of the model's input (.npz, .h5)")
    p.add_argument("--scored", help="folder that keeps the scored sites as Parquet")
    p.add_argument("--ordinal_join", action="store_true", help="windows by the columns' numbers, for few sites")
    p.add_argument("--window", type=int, default=16)
    p.add_argument("--version", action="version", version=__version__)
    return p


def session(cpus: int) -> SparkSession:
    """The session; where nothing else sets a master, one of so many tasks at once on this machine."""
    builder = SparkSession.builder.appName("ploidyflow")
    if SparkSession.getActiveSession() is None and "PYSPARK_GATEWAY_PORT" not in os.environ:
        builder = builder.master(f"local[{parallelism(cpus, os.cpu_count() or 1)}]")
    return builder.getOrCreate()


def checked_contigs(spark: SparkSession, contigs, bed: str | None, asked: list[str] | None) -> tuple[str, ...]:
    """Contigs to call: those of the regions, else those asked for, else all; ConfigError for unknown ones."""
    if bed:
        if asked:
            log.warning("--chroms is ignored as regions are given")
        chosen = bed_contigs(bed_lines(spark, bed)).orderBy("ord")
    elif asked:
        chosen = spark.createDataFrame([(x,) for x in dict.fromkeys(asked)], "chrom string")
    else:
        return ()
    unknown = [r.chrom for r in invalid_contigs(chosen, contigs).collect()]
    if unknown:
        raise ConfigError(f"the reference has no {', '.join(sorted(unknown))}")
    return tuple(r.chrom for r in chosen.collect())


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    for path in filter(None, (args.ref, args.bam, args.bed)):
        if "://" not in path and not os.path.exists(path):
            raise SystemExit(f"no such file: {path}")
    if (folder := os.path.dirname(args.output)) and not os.path.isdir(folder):
        raise SystemExit(f"no such folder: {folder}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    try:
        config = CallerConfig(ploidy=args.ploidy, species=args.species, mode=args.mode, min_af=args.min_af, rd_floor=args.rd_floor, window=args.window, ordinal_join=args.ordinal_join).checked()
        model, statistics = args.model, args.statistics
        if args.models:
            folder, window = model_folder(args.models, config.chosen_species(), config.mode)
            model, statistics = model_files(folder)
            config = replace(config, window=window)
        mean, std = read_statistics(statistics) if statistics else (None, None)
        spark = session(args.cpus)
        contigs = read_fai(spark, f"{args.ref}.fai") if os.path.exists(f"{args.ref}.fai") else fasta_contigs(spark, args.ref)
        names = checked_contigs(spark, contigs, args.bed, args.chroms)
        if args.bam.endswith(".sam"):
            reads, order = sam.read_sam(spark, args.bam), sam.sam_sort_order(spark, args.bam)
        else:
            bam.register(spark)
            reads, order = spark.read.format("bam").load(args.bam), bam.sort_order(args.bam)
        if order != "coordinate":
            log.warning("reads are in %s order; they are dealt anew, so this does no harm", order)
        config = replace(config, contigs=names)
        regions = read_bed(spark, args.bed) if args.bed else None
        near = None
        if regions is not None and not args.bam.endswith(".sam") and (wide := wide_regions(regions)) is not None:
            near = spark.read.format("bam").option("regions", json.dumps(wide)).load(args.bam)
        log.info("calling %s with %s", ", ".join(names) or "all contigs", model or "the binomial scorer")
        lines = call_variants(reads, fasta_blocks(spark, args.ref), contigs.select("chrom", "length", F.col("ord")), config, regions, model_predictor(model) if model else None, mean, std, args.scored, near)
    except ConfigError as e:
        raise SystemExit(str(e)) from e
    write_vcf(lines, f"{args.output}.gz", longest=contigs.agg(F.max("length")).first()[0] or 0)
    log.info("wrote %s.gz", args.output)


if __name__ == "__main__":
    main()
