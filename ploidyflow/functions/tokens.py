"""Expressions on pileup tokens.

A token is a base letter, `*` inside a deletion or `>`/`<` inside a skip; `+nSEQ`
after it says that an insertion of n bases follows, `-nNNN` that a deletion does.
Case carries no information: the strand is in the read's flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the SAM format: bits of a flag.
PAIRED, PROPER_PAIR, UNMAPPED, MATE_UNMAPPED, REVERSE = 1, 2, 4, 8, 16
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 256, 512, 1024, 2048
UNUSABLE = UNMAPPED | MATE_UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE | SUPPLEMENTARY
BASES = ("A", "C", "G", "T")


def strand(flag: Column) -> Column:
    """1 for the reverse strand."""
    return F.shiftright(flag.bitwiseAND(F.lit(REVERSE)), 4)


def first_letter(token: Column) -> Column:
    return F.upper(F.substring(token, 1, 1))


def snp_allele(token: Column, ref: Column) -> Column:
    """The base shown, if it isn't the reference's; null for it and for the bare `*`."""
    return F.when((token != "*") & (first_letter(token) != ref), first_letter(token))


def insertion(token: Column) -> Column:
    """`nSEQ` of an insertion that follows, else null."""
    return F.when(F.contains(token, F.lit("+")), F.upper(F.split_part(token, F.lit("+"), F.lit(2))))


def deletion(token: Column) -> Column:
    """`nNNN` of a deletion that follows, else null."""
    return F.when(F.contains(token, F.lit("-")), F.upper(F.split_part(token, F.lit("-"), F.lit(2))))


def indel_length(allele: Column) -> Column:
    return F.regexp_extract(allele, r"^(\d+)", 1).try_cast("int")


def indel_sequence(allele: Column) -> Column:
    return F.regexp_replace(allele, r"^\d+", "")


def soft_masked(base: Column, uppercase: bool = False) -> Column:
    """The base if it is an upper-case A, C, G or T, else `*`."""
    seen = F.upper(base) if uppercase else base
    return F.when(seen.isin(*BASES), seen).otherwise("*")


def base_code(base: Column) -> Column:
    """0 to 3 for A, C, G, T, else 4."""
    out = F.lit(4)
    for k, b in enumerate(BASES):
        out = F.when(base == b, F.lit(k)).otherwise(out)
    return out
