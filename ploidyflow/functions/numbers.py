"""Rounding and text of numbers, and genotype expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest probability below 1 that a 32-bit float can hold; keeps QUAL finite.
MOST_PROBABILITY = 1 - 2.0**-24


def half_even(x: Column) -> Column:
    """Nearest whole number, halves to the even one."""
    return F.bround(x, 0).cast("int")


def min_depth(depth: Column, ploidy: int, floor: int) -> Column:
    return F.greatest(half_even(depth / F.lit(ploidy)), F.lit(floor))


def allele_fraction(alt: Column, depth: Column) -> Column:
    """alt / depth to four places, by the exact value of the quotient."""
    return F.regexp_replace(F.format_number(alt / F.greatest(depth, F.lit(1)), 4), ",", "").cast("double")


def plain_number(x: Column, places: int = 4) -> Column:
    """Decimal text without an exponent: zeros at the end go, but one place stays."""
    text = F.regexp_replace(F.format_number(x, places), ",", "")
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", ".0")


def qual(probability: Column) -> Column:
    """Phred quality of a probability, to two places."""
    p = F.least(F.greatest(probability.cast("double"), F.lit(1e-8)), F.lit(MOST_PROBABILITY))
    return F.rint(F.lit(-10.0) * F.log10(F.lit(1.0) - p) * 100) / 100


def genotype(label: Column, ploidy: int) -> Column:
    """Zeros, then as many ones as the label says, joined by slashes."""
    return F.array_join(F.concat(F.array_repeat(F.lit("0"), F.lit(ploidy) - label), F.array_repeat(F.lit("1"), label)), "/")
