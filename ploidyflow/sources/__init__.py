"""Readers of FASTA, its index, BED, SAM and BAM."""
