"""Column expressions: pileup tokens, flags, rounding and genotype text."""
