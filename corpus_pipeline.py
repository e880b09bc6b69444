"""The corpus pipeline: documents in, packed pieces out. Each stage is written as Parquet in the shared
folder and read again by the next, so a lost executor costs no more than the stage it was in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusgrid.llm import packing, pii, positional, simhash, toxicity
from locusgrid.llm.catalog import tokenizer
from locusgrid.llm.common import stored, table

#: Packing needs a tokenizer, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough of the benchmark in them to count as contaminated."""
    return positional.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they go."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", civil),
    ("simhash_near_dedup", distinct),
    ("benchmark_decontamination", uncontaminated),
    ("pii", redacted),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
