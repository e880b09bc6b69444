"""Expressions over variant records. ``alt`` is the raw comma-separated ALT column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_alt(alt: Column) -> Column:
    return alt.isNotNull() & ~alt.isin(".", "")


def alts(alt: Column) -> Column:
    return F.when(has_alt(alt), F.split(alt, ",")).otherwise(F.array().cast("array<string>"))


def first_alt(alt: Column) -> Column:
    """First ALT, empty when there is none."""
    return F.when(has_alt(alt), F.substring_index(alt, ",", 1)).otherwise(F.lit(""))


def is_pass(filter_: Column) -> Column:
    return filter_.isNull() | filter_.isin("PASS", ".")


def has_sv(svtype: Column) -> Column:
    return svtype.isNotNull() & (svtype != "")


def is_snv(ref: Column, alt: Column) -> Column:
    a = first_alt(alt)
    return ref.rlike(r"\A\p{L}\z") & a.rlike(r"\A\p{L}\z")


def variant_class(ref: Column, alt: Column, svtype: Column) -> Column:
    """Summary profile: other, sv, snv, mnp, indel (decided on the first ALT)."""
    a = first_alt(alt)
    return (
        F.when(~has_alt(alt), F.lit("other"))
        .when(has_sv(svtype), F.lit("sv"))
        .when(is_snv(ref, alt), F.lit("snv"))
        .when((F.length(ref) == F.length(a)) & (F.length(ref) > 1), F.lit("mnp"))
        .otherwise(F.lit("indel"))
    )


def report_class(ref: Column, alt: Column, svtype: Column) -> Column:
    """Report profile: no "other" class and no letter test."""
    a = first_alt(alt)
    return (
        F.when(has_sv(svtype), F.lit("sv"))
        .when((F.length(ref) == 1) & (F.length(a) == 1), F.lit("snv"))
        .when(F.length(ref) == F.length(a), F.lit("mnp"))
        .otherwise(F.lit("indel"))
    )


def substitution(ref: Column, alt: Column) -> Column:
    """``ts``, ``tv`` or null for an identical pair; meaningful for SNVs only."""
    r, a = F.upper(ref), F.upper(first_alt(alt))
    pair = F.concat(F.least(r, a), F.greatest(r, a))
    return F.when(pair.isin("AG", "CT"), F.lit("ts")).when(r != a, F.lit("tv"))


def is_transition(ref: Column, alt: Column) -> Column:
    return F.coalesce(substitution(ref, alt) == "ts", F.lit(False))


def is_frameshift(ref: Column, alt: Column) -> Column:
    a = first_alt(alt)
    diff = F.abs(F.length(ref) - F.length(a))
    return (F.length(ref) > 0) & (F.length(a) > 0) & (diff % 3 != 0)
