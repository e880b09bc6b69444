"""Record gates: rows that break a rule are split off with the reasons, not dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from . import corpus


def _reasons(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for bad, why in rules]))


def _empty(c: str) -> Column:
    return F.col(c).isNull() | (T.strip(F.col(c).cast("string")) == "")


def with_reasons(df: DataFrame, reasons: Column) -> DataFrame:
    return df.withColumn("reasons", reasons)


def split_accepted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` of a frame with a ``reasons`` array."""
    ok = F.size("reasons") == 0
    return df.filter(ok).drop("reasons"), df.filter(~ok)


def finding_gate(findings: DataFrame) -> DataFrame:
    """``gene, name, tier, evidence, implication, triples, citations``: required text, tier 1-3,
    at least one triple, each with an rsID, and at least one citation."""
    no_id = F.coalesce(
        F.exists("triples", lambda t: t.rsid.isNull() | (t.rsid == "")), F.lit(False)
    )
    return with_reasons(findings, _reasons(
        *[(_empty(c), f"missing {c}") for c in ("gene", "name", "evidence", "implication")],
        (~F.col("tier").between(1, 3), "tier not 1-3"),
        (F.coalesce(F.size("triples"), F.lit(0)) < 1, "no triple"),
        (no_id, "triple without rsid"),
        (F.coalesce(F.size("citations"), F.lit(0)) < 1, "no citation"),
    ))


def claim_gate(claims: DataFrame) -> DataFrame:
    """``clinical, rsid, citation_keys``: a clinical claim needs an rsID and a citation."""
    clinical = F.coalesce("clinical", F.lit(True))
    return with_reasons(claims, _reasons(
        (clinical & _empty("rsid"), "clinical claim without rsid"),
        (clinical & (F.coalesce(F.size("citation_keys"), F.lit(0)) < 1), "clinical claim without citation"),
    ))


def alert_gate(alerts: DataFrame) -> DataFrame:
    return with_reasons(alerts, _reasons(
        *[(_empty(c), f"missing {c}") for c in ("drug", "gene_genotype", "evidence", "recommendation")],
    ))


def provenance_gate(blocks: DataFrame) -> DataFrame:
    """Every required field filled, phase 0-7, known assembly."""
    required = [f for f in K.PROVENANCE_FIELDS if f not in K.OPTIONAL_PROVENANCE_FIELDS]
    rules = []
    for f in required:
        empty = F.col(f).isNull() if f == "external_sources_used" else _empty(f)
        rules.append((empty, f"missing {f}"))
    rules.append((F.col("phase").isNotNull() & ~F.col("phase").between(0, 7), "phase not 0-7"))
    rules.append((
        ~_empty("source_genome_assembly") & ~F.col("source_genome_assembly").isin(*K.ASSEMBLIES),
        "unknown assembly",
    ))
    return with_reasons(blocks, _reasons(*rules))


def phrase_gate(docs: DataFrame, phrases=K.HEDGE_PHRASES, key: str = "doc") -> tuple[DataFrame, DataFrame]:
    """``(kept documents, hits)``: a document with any live phrase hit is withheld."""
    hits = corpus.phrase_hits(docs, phrases, key)
    return docs.join(hits.select(key).distinct(), key, "left_anti"), hits


def tier_counts(findings: DataFrame, group: str = "doc_id") -> DataFrame:
    """Findings per document in all and by tier."""
    return findings.groupBy(group).agg(
        F.count(F.lit(1)).alias("all_tiers"),
        *[F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in (1, 2, 3)],
    )


def docs_per_group(manifest_docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Documents per report group; a listed group without documents counts 0."""
    n = manifest_docs.groupBy("group").agg(F.count(F.lit(1)).alias("n_docs"))
    if groups is None:
        return n
    return groups.select("group").join(n, "group", "left").select(
        "group", F.coalesce("n_docs", F.lit(0).cast("bigint")).alias("n_docs")
    )
