"""Registered queries: each runs an operator over the test views and, where plain SQL can say the
same, carries that SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .functions import evidence as XE
from .functions import genotype as XG
from .functions import sequence as XS
from .functions import text as XT
from .functions import variant as XV
from .operators import alignments as OA  # noqa: F401
from .operators import calls as OC
from .operators import corpus as OD
from .operators import evidence as OE
from .operators import gates as OG
from .operators import intervals as OI
from .operators import keyed as OK
from .operators import sequences as OS
from .operators import variants as OV
from .plans import jobs
from .session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """The test views of one data folder, under the column names the operators use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str, **prepare) -> DataFrame:
        return views.view(self.spark, self.sf_dir, name, **prepare)

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)

    @property
    def calls(self):
        return self("v_calls")

    @property
    def docs(self):
        return self("v_docs", prepare=spread).withColumnRenamed("doc_id", "doc")

    @property
    def reads(self):
        r = self("v_reads", prepare=spread)
        return r.select(
            F.lit("reads").alias("path"), F.col("read_id").alias("read_no"),
            F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("name"), "seq", "qual",
        )

    @property
    def sequences(self):
        return self.reads.select("path", F.col("name").alias("seq_id"), F.col("seq").alias("sequence"))

    @property
    def gff(self):
        return self("v_features").select(
            "chrom", "source", "feature_type", (F.col("start0") + 1).alias("start1"),
            F.col("end0").alias("end1"), F.lit(".").alias("score"), "strand", "attributes", "feature_id",
        )

    @property
    def index(self):
        return OE.index_join(OD.first_seen_pool(self.docs), self.calls)


def query(name: str, uses: str = "", sql: str | None = None, ctes: str = ""):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            parts = [p for p in (views.duckdb_ctes(*uses.split()) if uses else "", ctes.strip().rstrip(",")) if p]
            ORACLES[name] = ("with " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()
        return fn

    return register


# --- shared SQL fragments (second engine) -----------------------------------

LAST = """
c_last as (select rsid, arg_max(chrom, line_no) as chrom, arg_max(pos, line_no) as pos, arg_max(genotype, line_no) as genotype
  from v_calls group by rsid)"""
LAST_SAMPLE = """
c_last as (select sample_id, rsid, arg_max(chrom, line_no) as chrom, arg_max(pos, line_no) as pos, arg_max(genotype, line_no) as genotype
  from v_calls group by sample_id, rsid)"""
POOL = r"""
d_tok as (select doc_id as doc, unnest(regexp_extract_all(text, '\brs[0-9]+\b')) as rsid, unnest(generate_series(1, len(regexp_extract_all(text, '\brs[0-9]+\b')))) as n from v_docs),
d_first as (select doc, rsid, min(n) as n from d_tok group by doc, rsid),
d_pos as (select doc, rsid, row_number() over (partition by doc order by n) - 1 as pos from d_first),
pool as (select rsid, min(doc) as first_doc, arg_min(pos, doc) as first_pos from d_pos group by rsid)"""
# Citing documents per id in parts: the rule of ``keyed.value_lists`` with its ``LIST_LIMIT``.
SOURCES = """
d_pair as (select distinct rsid, cast(doc as varchar) as doc from d_tok),
d_size as (select rsid, count(*) as n_values from d_pair group by rsid),
d_dealt as (select *, cast('0x' || substr(md5(doc), 1, 15) as bigint) % cast(ceil(n_values * 2 / 10000) as bigint) as part from d_pair join d_size using (rsid)),
d_list as (select rsid, row_number() over (partition by rsid order by part) - 1 as part_no, n_values, string_agg(doc, ',' order by doc) as source_docs
  from d_dealt group by rsid, n_values, part)"""
INDEX = POOL + "," + LAST + """,
idx as (select pool.*, coalesce(chrom, '') as chromosome, coalesce(cast(pos as varchar), '') as position, coalesce(genotype, 'not_tested') as genotype,
  case when coalesce(genotype, 'not_tested') in ('', 'not_tested', '--') then 'n' else 'y' end as found from pool left join c_last using (rsid))"""
LINES = r"""
d_raw as (select doc_id as doc, string_split(case when right(text, 1) = chr(10) then left(text, length(text) - 1) else text end, chr(10)) as ls from v_docs),
d_lines as (select doc, unnest(generate_series(1, len(ls))) as lineno, unnest(ls) as line from d_raw)"""
STATES = LINES + r""",
d_f as (select *, regexp_matches(line, '^\s*```') as is_fence, regexp_matches(line, '^\s*#+([^#\s]|\s.*\S)') as is_head,
  regexp_matches(line, '^\s*>') as is_q, contains(line, '[verbatim from archive') as mk from d_lines),
d_fm as (select doc, min(lineno) filter (where trim(line) = '---' and lineno > 1) as e, max(lineno) as n, bool_or(lineno = 1 and trim(line) = '---') as has
  from d_lines group by doc),
d_g as (select d_f.*, case when has then coalesce(e, n) else 0 end as fm, lineno - row_number() over (partition by d_f.doc, is_q order by lineno) as grp from d_f join d_fm using (doc)),
d_s as (select doc, lineno, line, mk,
  is_fence or coalesce(sum(cast(is_fence as int)) over (partition by doc order by lineno rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as fenced,
  lineno > fm and (is_fence or coalesce(sum(cast(is_fence and lineno > fm as int)) over (partition by doc order by lineno rows between unbounded preceding and 1 preceding), 0) % 2 = 1) as code,
  lineno <= fm as front_matter,
  coalesce(last_value(case when is_head then trim(ltrim(line, '#')) end ignore nulls) over (partition by doc order by lineno rows between unbounded preceding and current row), '') as heading,
  is_q and bool_or(mk) over (partition by doc, is_q, grp) as archive_quote from d_g)"""
HITS = STATES + r""",
d_open as (select doc, lineno, line, regexp_replace(regexp_replace(line, '`[^`]*`', ' ', 'g'), '[\x{C0}-\x{24F}]', 'x', 'g') as scan, regexp_matches(line, 'PMID|VCV|RCV|CPIC|PharmGKB|FDA|GCST|rs|gnomAD') as cited from d_s
  where not fenced and not archive_quote and not mk and not (contains(lower(heading), 'glossary') or contains(lower(heading), 'appendix'))),
d_hit0 as (select doc, lineno, cited, unnest(regexp_extract_all(scan, '(?i)\be\.g\.|\betc\.|\bothers\b|\bincluding but not limited to\b|\bmay\b|\bmight\b|\bcould\b|\bshould consider\b|\blikely\b-pathogenic|\blikely\b-benign|\blikely\b|\broughly\b|\bapproximately\b|\bbest\b|\brecommended\b|\bprefer\b|\boptional\b|\bif applicable\b|\bwhere supported\b|\bas needed\b')) as t from d_open),
d_hit as (select doc, lineno, case when lower(t) in ('likely-pathogenic', 'likely-benign') then left(t, 6) else t end as token from d_hit0
  where not (cited and lower(t) in ('likely-pathogenic', 'likely-benign')))"""
CLAIMS = HITS + r""",
d_hl as (select doc, lineno, list_sort(list(token)) as tokens from d_hit group by doc, lineno),
d_c0 as (select s.doc, s.lineno, trim(line) as text, list_distinct(regexp_extract_all(line, '\brs[0-9]+\b')) as rsu, coalesce(tokens, []) as tokens, line,
  regexp_matches(line, '\b(CYP2D6|CYP2C19|CYP2C9|CYP1A2|CYP3A4|CYP3A5|VKORC1|TPMT|NUDT15|NAT2|UGT1A1|SLCO1B1|DPYD|MTHFR|MTR|MTRR|CBS|BHMT|AHCY|SHMT1|MAT1A|TYMS|ABCB11|NR1H4|ABCB4|GC|NPC1L1|APOA5)\b') as gene,
  regexp_matches(line, '(?i)\b(risk|metabolizer|metabolism|deficiency|sensitivity|dose|dosing|dosage|supplement|allele|carrier|variant|genotype|pathogenic|enzyme)\b') as noun
  from d_s s left join d_hl using (doc, lineno)
  where not front_matter and not code and trim(line) <> '' and not regexp_matches(line, '^\s*\|?\s*:?-{3,}')),
d_c1 as (select *, len(rsu) > 0 or gene or noun as clinical,
  regexp_matches(line, '(?i)PMID|VCV\d+|RCV\d+|ClinVar|CPIC|PharmGKB|FDA|GCST\d+|GWAS Catalog|gnomAD|https://pubmed\.ncbi\.nlm\.nih\.gov/|https://www\.ncbi\.nlm\.nih\.gov/clinvar/|https://cpicpgx\.org/guidelines/|https://www\.pharmgkb\.org/|https://www\.fda\.gov/drugs/science-and-research-drugs/table-pharmacogenomic-biomarkers-drug-labeling|https://www\.ebi\.ac\.uk/gwas/|https://www\.ncbi\.nlm\.nih\.gov/snp/|https://gnomad\.broadinstitute\.org/') as has_citation,
  list_distinct(list_transform(regexp_extract_all(line, '\b(?:[ACGT]{2}|[ACGT][/|][ACGT]|[DI]{2})\b|\B--\B'),
    lambda g: case when regexp_full_match(replace(replace(g, '/', ''), '|', ''), '[ACGT]{2}') then list_aggregate(list_sort(string_split(replace(replace(g, '/', ''), '|', ''), '')), 'string_agg', '') else g end)) as gts
  from d_c0 where len(rsu) > 0 or gene or noun or len(tokens) > 0),
d_claim as (select doc, lineno, text, rsu, tokens, clinical, has_citation, case when len(rsu) = 1 and len(gts) = 1 then gts[1] end as stated_genotype from d_c1)"""
AUDIT = CLAIMS + "," + INDEX + r""",
d_ids as (select doc, lineno, unnest(rsu) as rsid from d_claim),
d_sup as (select doc, lineno, list_sort(list(rsid) filter (where found = 'y')) as sup, list_sort(list(rsid) filter (where found is null)) as abs, max(genotype) as gt, max(found) as fd, count(*) as n
  from d_ids left join idx using (rsid) group by doc, lineno),
d_claims as (select c.*, coalesce(sup, []) as supporting, coalesce(abs, []) as absent,
  case when stated_genotype is not null and fd = 'y' then stated_genotype <> case when regexp_full_match(gt, '[ACGT]{2}') then list_aggregate(list_sort(string_split(gt, '')), 'string_agg', '') else gt end end as genotype_mismatch,
  case when len(tokens) > 0 then 'delete' when clinical and len(coalesce(sup, [])) = 0 then 'delete'
    when len(coalesce(sup, [])) > 0 and not has_citation then 'rewrite-with-citation' else 'keep' end as disposition
  from d_claim c left join d_sup using (doc, lineno))"""
CPIC = r"""
cp as (select gene, drug, case when upper(trim(level)) in ('A', 'LEVEL A') then 'A' when upper(trim(level)) in ('B', 'LEVEL B') then 'B' end as lv, regexp_extract_all(defining_rsids, 'rs\d+') as rs from v_cpic),
cp_ab as (select * from cp where lv is not null),
cp_pairs as (select distinct unnest(rs) as rsid, gene from cp_ab)"""
CLINVAR = """
cv as (select * from v_clinvar where lower(trim(significance)) in ('pathogenic', 'likely pathogenic'))"""
PASSES = CPIC + "," + CLINVAR + "," + LAST_SAMPLE + r""",
univ as (select rsid from cv union select rsid from cp_pairs),
called as (select c.* from c_last c join univ using (rsid) where trim(genotype) not in ('', 'not_tested', '--')),
mt as (select called.*, cv.pathogenic_allele, cv.gene, cv.vcv, cv.significance,
  case when not regexp_full_match(pathogenic_allele, '[ACGT]') then null else contains(genotype, pathogenic_allele) or contains(genotype, translate(pathogenic_allele, 'ACGT', 'TGCA')) end as allele_matched,
  case when not regexp_full_match(pathogenic_allele, '[ACGT]') then 'unmatched' when contains(genotype, pathogenic_allele) then 'direct'
    when contains(genotype, translate(pathogenic_allele, 'ACGT', 'TGCA')) then 'complement' else 'none' end as strand
  from called join cv using (rsid)),
pa as (select *, gene in ('Brand#1', 'Brand#2') as acmg from mt where allele_matched is distinct from false),
pc as (select called.*, cp_pairs.gene as cpic_gene from called join cp_pairs using (rsid)),
pu as (select sample_id, rsid, chrom, pos, genotype, concat_ws(',', case when max(a) = 1 then 'A' end, case when max(b) = 1 then 'B' end, case when max(c) = 1 then 'C' end) as passes
  from (select sample_id, rsid, chrom, pos, genotype, 1 as a, cast(acmg as int) as b, 0 as c from pa union all select sample_id, rsid, chrom, pos, genotype, 0, 0, 1 from pc)
  group by sample_id, rsid, chrom, pos, genotype)"""
# Test gene panel for the secondary-findings flag.
GENE_PANEL = ("Brand#1", "Brand#2")


from . import catalog_calls, catalog_docs, catalog_io  # noqa: E402,F401
