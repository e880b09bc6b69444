"""Expressions over reference tables, citations and feature attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import strip


def norm_level(level: Column) -> Column:
    v = strip(F.upper(level))
    return F.when(v.isin("A", "LEVEL A"), F.lit("A")).when(v.isin("B", "LEVEL B"), F.lit("B"))


def is_pathogenic(significance: Column) -> Column:
    return F.lower(strip(significance)).isin(*K.PATHOGENIC_CLASSES)


def defining_rsids(csv: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(csv, F.lit("(?U)rs\\d+"), F.lit(0)))


def citation_url(template: Column, identifier: Column) -> Column:
    digits = F.regexp_replace(identifier, r"(?U)\D", "")
    return F.replace(F.replace(template, F.lit("{id_numeric}"), digits), F.lit("{id}"), identifier)


def ledger_id(identifier: Column) -> Column:
    return F.regexp_replace(identifier, "[^A-Za-z0-9._-]", "_")


def ledger_key(identifier: Column, snapshot_date: Column) -> Column:
    return F.concat(ledger_id(identifier), F.lit("_"), F.date_format(snapshot_date, "yyyyMMdd"))


def to_one_based(start0: Column) -> Column:
    return start0 + 1


def to_zero_based(start1: Column) -> Column:
    return start1 - 1


def feature_name(attributes: Column) -> Column:
    gff = F.regexp_extract(attributes, r"(?:^|;)\s*ID=([^;]+)", 1)
    gtf = F.regexp_extract(attributes, r'gene_id\s+"([^"]+)"', 1)
    return F.when(gff != "", strip(gff)).when(gtf != "", gtf).otherwise(F.lit("."))
