"""Expressions over genotype strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import strip


def is_no_call(genotype: Column, profile: str = "summary") -> Column:
    value = strip(genotype)
    if profile == "vcf":
        value = strip(F.upper(genotype))
    return value.isin(*K.NO_CALLS[profile])


def genotype_found(genotype: Column) -> Column:
    """``y`` when the site was called, else ``n``."""
    return F.when(is_no_call(genotype, "index"), F.lit("n")).otherwise(F.lit("y"))


def split_alleles(genotype: Column) -> Column:
    """Array of allele letters; empty for a no-call."""
    letters = F.regexp_extract_all(F.upper(strip(genotype)), F.lit("[ACGTID]"), F.lit(0))
    return F.when(is_no_call(genotype, "vcf"), F.array().cast("array<string>")).otherwise(letters)


def gt_code(alleles: Column, ref: Column, alt: Column) -> Column:
    coded = F.transform(
        alleles,
        lambda a: F.when(a == ref, F.lit("0")).when(a == alt, F.lit("1")).otherwise(F.lit(".")),
    )
    return F.array_join(coded, "/")


def norm_genotype(genotype: Column) -> Column:
    """Order-free form of a two-letter call: ``A/G`` and ``GA`` both become ``AG``."""
    g = strip(F.translate(genotype, "/|", ""))
    first, second = F.substring(g, 1, 1), F.substring(g, 2, 1)
    pair = F.concat(F.least(first, second), F.greatest(first, second))
    return F.when(g.rlike(r"\A[ACGT]{2}\z"), pair).otherwise(g)


def allele_match(genotype: Column, allele: Column) -> Column:
    """``struct<matched boolean, strand string>``; null ``matched`` for a non-SNV allele."""
    a = F.upper(strip(allele))
    g = F.upper(genotype)
    direct = g.contains(a)
    complement = g.contains(F.translate(a, "ACGT", "TGCA"))
    snv = a.rlike(r"\A[ACGT]\z")
    matched = F.when(snv, direct | complement)
    strand = (
        F.when(~snv, F.lit("unmatched"))
        .when(direct, F.lit("direct"))
        .when(complement, F.lit("complement"))
        .otherwise(F.lit("none"))
    )
    return F.struct(matched.alias("matched"), strand.alias("strand"))
