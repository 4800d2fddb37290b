"""Schemas of the tables that operators exchange."""

READS = "qname string, flag int, chrom string, pos bigint, mapq int, cigar string, seq string"
CONTIGS = "chrom string, length bigint, ord int"
OBSERVATIONS = "chrom string, pos bigint, qname string, flag int, mapq int, token string"
REGIONS = "chrom string, start1 bigint, end1 bigint"
SCORED = "chrom string, pos bigint, ref string, alt string, kind string, rd int, ref_num int, alt_num int, pred_prob double, pred_label int"
