"""A sample of the registered queries against their SQL; ``tools/check.py`` runs all of them."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare

SF = "/root/testdata/sf0.001"
SAMPLE = ["last_wins", "lookup_calls", "calls_to_vcf", "variant_summary", "top_quality", "overlap_join", "fasta_summary", "fastq_summary",
          "qc_per_base_box", "translate_frames", "phrase_hits", "audit_claims", "verify_corpus", "pass_union", "discover_candidates",
          "table_fingerprint", "read_fastq", "write_index"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    line = compare(spark, con, name, SF)
    assert line.startswith("ok"), line


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 140
