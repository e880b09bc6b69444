"""Test views over the driver tables: one SQL text per view, in two dialects.

``{S}`` is the string type, ``{G}`` the replace-all flag, ``{N}`` a line break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"S": "string", "G": "", "N": r"'\n'", "B": "bigint"}
DUCKDB = {"S": "varchar", "G": ", 'g'", "N": "chr(10)", "B": "bigint"}

SQL = {
    "v_calls": """
select l_suppkey as sample_id, concat('rs', cast(l_partkey as {S})) as rsid, cast(1 + l_partkey % 22 as {S}) as chrom, l_partkey * 1000 as pos,
  case when l_tax = 0 then '--' else concat(substr('ACGT', cast(1 + cast(l_quantity as int) % 4 as int), 1), substr('ACGT', cast(1 + l_linenumber % 4 as int), 1)) end as genotype,
  l_orderkey * 10 + l_linenumber as line_no from lineitem""",
    "v_rsmap": """
select concat('rs', cast(p_partkey as {S})) as rsid, cast(1 + p_partkey % 22 as {S}) as chrom, p_partkey * 1000 as pos,
  substr('ACGT', cast(1 + p_partkey % 4 as int), 1) as ref, substr('ACGT', cast(1 + (p_partkey + 1 + p_size % 3) % 4 as int), 1) as alt from part where p_partkey % 5 <> 0""",
    "v_variants": """
select concat('chr', cast(1 + l_partkey % 22 as {S})) as chrom, l_partkey * 1000 + l_linenumber as pos, concat('rs', cast(l_partkey as {S})) as id,
  case when l_linenumber % 5 in (0, 1) then substr('ACGT', cast(1 + l_partkey % 4 as int), 1) when l_linenumber % 5 = 2 then substr('ACGTAC', 1, cast(2 + l_suppkey % 4 as int)) when l_linenumber % 5 = 3 then 'AC' else 'A' end as ref,
  case when l_linenumber % 5 in (0, 1) then substr('ACGT', cast(1 + (l_partkey + 1 + l_suppkey % 3) % 4 as int), 1) when l_linenumber % 5 = 2 then 'A' when l_linenumber % 5 = 3 then 'GT' when l_suppkey % 2 = 0 then '.' else 'ATG,G' end as alt,
  case when l_discount = 0 then null else l_extendedprice end as qual, case when l_returnflag = 'R' then 'lowQ' when l_returnflag = 'A' then '.' else 'PASS' end as filter,
  case when l_quantity = 50 then 'DEL' end as svtype, l_orderkey * 10 + l_linenumber as row_id from lineitem""",
    "v_reads": """
select doc_id as read_id, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', 'N'{G}) as seq,
  regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJ56789;<=>?@01234'), '[^0-9;<=>?@A-J]', '#'{G}) as qual from documents""",
    "v_features": """
select concat('chr', cast(1 + o_custkey % 22 as {S})) as chrom, o_orderkey * 10 as start0, o_orderkey * 10 + 1 + o_custkey % 500 as end0, o_orderstatus as source, o_orderpriority as feature_type,
  case when o_orderkey % 2 = 0 then '+' else '-' end as strand, concat('ID=f', cast(o_orderkey as {S}), ';Parent=c', cast(o_custkey as {S})) as attributes, o_orderkey as feature_id from orders""",
    "v_docs": """
select doc_id, concat(case when doc_id % 11 = 0 then concat('---', {N}, 'phase: 3', {N}, 'source_genome_sha256: ', case when doc_id % 2 = 0 then 'ABC' else 'DEF' end, {N}, '---', {N}) else '' end,
  '# Doc ', cast(doc_id as {S}), {N}, case when doc_id % 13 <> 0 then concat('## Provenance Summary', {N}) else '' end,
  'rs', cast(doc_id % 100 as {S}), case doc_id % 3 when 0 then ' AG' when 1 then ' GG' else ' C/T' end, ' enzyme activity', case when doc_id % 2 = 0 then ' per CPIC guideline' else '' end, {N},
  'Seen: `rs', cast(doc_id % 100 as {S}), ' ', cast(1 + doc_id % 22 as {S}), ':', cast(1 + doc_id % 9 as {S}), ',000 AG` and rs', cast(doc_id as {S}), {N},
  case when doc_id % 3 = 0 then concat('This variant may benefit and Could shift risk for rs', cast(doc_id % 50 as {S}), {N}) else '' end,
  case when doc_id % 6 = 0 then concat('CYP2D6 rs', cast(doc_id % 30 as {S}), ' is likely-pathogenic per ClinVar VCV000000123', {N}) when doc_id % 6 = 1 then concat('MTHFR likely normal metabolizer', {N}) else '' end,
  case when doc_id % 4 = 0 then concat('> [verbatim from archive: a.md]', {N}, '> could roughly double', {N}) else concat('> plain quote might vary', {N}) end,
  case when doc_id % 5 = 0 then concat('```', {N}, 'may might could', {N}, '```', {N}) else '' end, 'Token `may` cited as data', {N},
  case when doc_id % 7 = 0 then concat('## Appendix', {N}, 'etc. and others', {N}) else '' end, '## Body', {N}, text) as text from documents""",
    "v_clinvar": """
select concat('rs', cast(p_partkey as {S})) as rsid, substr('ACGT', cast(1 + p_size % 4 as int), 1) as pathogenic_allele, p_brand as gene, concat('VCV', lpad(cast(p_partkey as {S}), 9, '0')) as vcv,
  case when p_size % 3 = 0 then 'Pathogenic' when p_size % 3 = 1 then 'Likely pathogenic' else 'Benign' end as significance from part""",
    "v_cpic": """
select concat('GENE', cast(s_nationkey as {S})) as gene, s_name as drug, case s_suppkey % 4 when 0 then 'A' when 1 then 'Level B' when 2 then 'C' else 'D' end as level,
  concat('rs', cast(s_suppkey * 3 as {S}), ',rs', cast(s_suppkey * 7 as {S})) as defining_rsids from supplier""",
    # Requested ids per sample: the listed id on even lines, its neighbour on odd ones.
    "v_requests": """
select l_suppkey as sample_id, l_orderkey * 10 + l_linenumber as req_no, concat('rs', cast(l_partkey + l_linenumber % 2 as {S})) as rsid from lineitem""",
    # Citation ledger of one snapshot: some entries missing, some not verified.
    "v_ledger": """
select 'clinvar' as source_key, concat('VCV', lpad(cast(p_partkey as {S}), 9, '0')) as identifier, date '2026-01-15' as snapshot_date,
  concat('https://www.ncbi.nlm.nih.gov/clinvar/variation/', lpad(cast(p_partkey as {S}), 9, '0'), '/') as url, p_size % 4 <> 0 as url_verified from part where p_partkey % 3 <> 0""",
    # Citations in use: listed and unlisted sources, URLs in and out of their root.
    "v_citations": """
select o_orderkey as citation_id, case o_orderkey % 4 when 0 then 'pubmed' when 1 then 'clinvar' when 2 then 'dbsnp' else 'blog' end as source_key,
  concat(case o_custkey % 3 when 0 then 'https://pubmed.ncbi.nlm.nih.gov/' when 1 then 'https://www.ncbi.nlm.nih.gov/clinvar/' else 'https://www.ncbi.nlm.nih.gov/snp/' end, cast(o_custkey as {S})) as url from orders""",
}


def sql(name: str, dialect: dict = SPARK) -> str:
    text = SQL[name].strip()
    for key in ("S", "G", "N"):
        text = text.replace("{" + key + "}", dialect[key])
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, prepare=lambda df: df) -> DataFrame:
    """The view as a DataFrame; the driver table is read under its own name for this query only. ``prepare`` is
    applied to that table, below the view's expressions."""
    text = sql(name)
    source = text.split(" from ")[-1].split()[0]
    return spark.sql(text.rsplit(f" from {source}", 1)[0] + " from {src}" +
                     text.rsplit(f" from {source}", 1)[1], src=prepare(table(spark, sf_dir, source)))


def duckdb_ctes(*names: str) -> str:
    """``name as (...)`` list for a WITH clause."""
    return ",\n".join(f"{n} as ({sql(n, DUCKDB)})" for n in names)
