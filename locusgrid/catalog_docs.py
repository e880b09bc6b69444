"""Registered queries over documents, the truth index, clinical references and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import constants as K
from .catalog import (
    AUDIT, CLAIMS, CLINVAR, CPIC, GENE_PANEL, HITS, INDEX, LAST_SAMPLE, LINES, OD, OE, OG, OK, PASSES,
    POOL, SOURCES, STATES, XE, XG, XT, jobs, query,
)

# --- line state ---------------------------------------------------------------


@query("doc_lines", "v_docs", "select doc, lineno, line from d_lines", LINES)
def _(v):
    return OD.doc_lines(v.docs).withColumn("lineno", F.col("lineno").cast("bigint"))


def _lineno(df):
    return df.withColumn("lineno", F.col("lineno").cast("bigint"))


@query("fence_state", "v_docs", "select doc, lineno, line, fenced from d_s", STATES)
def _(v):
    return _lineno(OD.fence_state(v.docs))


@query("current_heading", "v_docs", "select doc, lineno, line, heading from d_s", STATES)
def _(v):
    return _lineno(OD.current_heading(v.docs))


@query("quote_runs", "v_docs", "select doc, lineno, line, archive_quote from d_s", STATES)
def _(v):
    return _lineno(OD.quote_runs(v.docs))


@query("frontmatter_span", "v_docs", "select doc, lineno, line, front_matter from d_s", STATES)
def _(v):
    return _lineno(OD.front_matter_span(v.docs))


@query("frontmatter_map", "v_docs", """
select doc_id as doc, case when doc_id % 11 = 0 then '3' end as phase, case when doc_id % 11 = 0 then case when doc_id % 2 = 0 then 'ABC' else 'DEF' end end as source_genome_sha256,
  case when doc_id % 11 = 0 then 2 else 0 end as n_fields from v_docs""")
def _(v):
    m = F.col("front_matter")
    return OD.front_matter_map(v.docs).select(
        "doc", F.try_element_at(m, F.lit("phase")).alias("phase"),
        F.try_element_at(m, F.lit("source_genome_sha256")).alias("source_genome_sha256"),
        F.size(m).alias("n_fields"),
    )


@query("sections", "v_docs", r"""
select doc, section_no, trim(substr(min(line) filter (where starts_with(line, '## ')), 4)) as heading,
  trim(coalesce(string_agg(line, chr(10) order by lineno) filter (where not starts_with(line, '## ')), ''), ' ' || chr(10) || chr(9)) as body
from (select *, sum(cast(starts_with(line, '## ') as int)) over (partition by doc order by lineno rows between unbounded preceding and current row)::bigint as section_no from d_lines)
where section_no > 0 group by doc, section_no""", LINES)
def _(v):
    return OD.sections(v.docs).withColumn("section_no", F.col("section_no").cast("bigint"))


@query("canonical_docs", "v_docs", """
select doc_id from v_docs where doc_id % 7 not in (0, 1, 2, 3)""")
def _(v):
    name = F.element_at(
        F.array(*[F.lit(x) for x in ("SPEC_a.md", "INDEX_b.md", "REPORT_c.md", "CHANGELOG.md", "d.md", "e.md", "notes.md")]),
        (F.col("doc") % 7).cast("int") + 1,
    )
    d = v.docs.select(F.col("doc").alias("doc_id"), name.alias("doc"))
    return OD.canonical_docs(d).select("doc_id")


@query("live_lines", "v_docs", "select doc, lineno, line from d_s where not archive_quote and not mk", STATES)
def _(v):
    return _lineno(OD.live_lines(v.docs))


# --- ids and phrases ------------------------------------------------------------

@query("doc_tokens_first_seen", "v_docs", "select doc, rsid, pos from d_pos", POOL)
def _(v):
    return OD.doc_tokens(v.docs).withColumn("pos", F.col("pos").cast("bigint"))


@query("first_seen_pool", "v_docs", "select rsid, first_doc, first_pos from pool", POOL)
def _(v):
    return OD.first_seen_pool(v.docs).withColumn("first_pos", F.col("first_pos").cast("bigint"))


@query("citing_docs", "v_docs", "select distinct rsid, doc from d_tok", POOL)
def _(v):
    return OD.citing_docs(v.docs)


@query("source_docs", "v_docs", "select rsid, part_no, n_values, source_docs from d_list", POOL + "," + SOURCES)
def _(v):
    pairs = OD.citing_docs(v.docs).withColumn("doc", F.col("doc").cast("string"))
    return OK.value_lists(pairs, "rsid", "doc", "source_docs")


@query("token_counts", "v_docs", "select rsid, count(*) as occurrences from d_tok group by rsid", POOL)
def _(v):
    return OD.token_counts(v.docs)


@query("phrase_hits", "v_docs", "select doc, lineno, token from d_hit", HITS)
def _(v):
    return _lineno(OD.phrase_hits(v.docs))


@query("narrow_hits", "v_docs", """
select doc, lineno from d_s where not fenced and not archive_quote and not mk
  and regexp_matches(line, '(?i)may benefit|might consider|could be helpful|future possibility|patients with this variant often')""", STATES)
def _(v):
    return _lineno(OD.narrow_hits(v.docs))


@query("phrase_gate", "v_docs", "select doc_id as doc from v_docs where doc_id not in (select doc from d_hit)", HITS)
def _(v):
    return OG.phrase_gate(v.docs)[0].select("doc")


@query("genotype_triples", "v_docs", r"""
select doc, regexp_extract(t, 'rs\d+') as rsid, regexp_extract(t, '(--|[ACGTDI]{1,2})`$', 1) as genotype
from (select doc_id as doc, unnest(regexp_extract_all(text, '`rs\d+\s+[0-9XYMT]+:[\d,]+\s+(?:--|[ACGTDI]{1,2})`')) as t from v_docs)""")
def _(v):
    t = OK.unnest(v.docs, ["doc"], XT.genotype_triples(F.col("text")), "t")
    return t.select("doc", "t.rsid", "t.genotype")


@query("project_terms", "v_docs", r"""
select doc, lineno, concat_ws(',', case when regexp_matches(line, '(?i)\bbody\b') then 'BODY' end, case when regexp_matches(line, '(?i)\benzyme activity\b') then 'enzyme activity' end) as terms from d_lines""", LINES)
def _(v):
    lines = _lineno(OD.doc_lines(v.docs))
    return lines.select("doc", "lineno", F.array_join(XT.term_hits(F.col("line"), ["enzyme activity", "BODY"]), ",").alias("terms"))


# --- truth index -----------------------------------------------------------------

@query("index_join", "v_docs v_calls", "select rsid, chromosome, position, genotype, found, 0 as discovered_in_phase from idx", INDEX)
def _(v):
    return v.index.drop("first_doc", "first_pos")


@query("index_by_sample", "v_docs v_calls", """
select sample_id, rsid, chrom as chromosome, pos as position, genotype, case when trim(genotype) in ('', 'not_tested', '--') then 'n' else 'y' end as found
from c_last where rsid in (select rsid from pool)""", POOL + "," + LAST_SAMPLE)
def _(v):
    return OE.index_by_sample(OD.first_seen_pool(v.docs), v.calls)


@query("sample_coverage", "v_docs v_calls", """
select sample_id, (select count(*) from pool) as pool_size, count(*) filter (where genotype <> '--') as found, count(*) filter (where genotype = '--') as no_call,
  (select count(*) from pool) - count(*) as not_tested from c_last where rsid in (select rsid from pool) group by sample_id""", POOL + "," + LAST_SAMPLE)
def _(v):
    pool = OD.first_seen_pool(v.docs)
    return OE.sample_coverage(OE.index_by_sample(pool, v.calls), pool)


@query("index_coverage", "v_docs v_calls", """
select count(*) as cited, count(*) filter (where found = 'y') as found, count(*) filter (where found = 'n') as not_found from idx""", INDEX)
def _(v):
    return OE.index_coverage(v.index)


@query("build_truth_index", "v_docs v_calls", """
select distinct i.rsid, i.genotype, d.doc from idx i join d_tok d using (rsid) where found = 'n'""", INDEX)
def _(v):
    return jobs.build_truth_index(v.docs, v.calls)["gaps"].select("rsid", "genotype", "doc")


@query("panel_checklist", "v_docs v_calls v_clinvar", """
select c.gene, c.rsid, coalesce(i.found, '? (absent from INDEX)') as found from v_clinvar c left join idx i using (rsid)""", INDEX)
def _(v):
    return OE.panel_checklist(v("v_clinvar").select("gene", "rsid"), v.index)


@query("methylation_panel", "v_docs v_calls", """
select p.gene, p.rsid, coalesce(i.found, '? (absent from INDEX)') as found from (values %s) p(gene, rsid) left join idx i using (rsid)"""
       % ", ".join(f"('{g}', '{r}')" for g, r in K.METHYLATION_PANEL), INDEX)
def _(v):
    return OE.panel_checklist(OE.fixed_panel(v.spark), v.index)


@query("probe_consistency", "v_docs v_calls", """
select sample_id, rsid, c.genotype, i.genotype as index_genotype from v_calls c join idx i using (rsid) where c.genotype <> i.genotype""", INDEX)
def _(v):
    return OE.probe_consistency(v.calls.select("sample_id", "rsid", "genotype"), v.index)


# --- claims -----------------------------------------------------------------------

@query("claim_lines", "v_docs", """
select doc, lineno, text, array_to_string(list_sort(rsu), ',') as rsids, array_to_string(tokens, ',') as tokens, clinical, has_citation, stated_genotype from d_claim""", CLAIMS)
def _(v):
    return _lineno(OD.claim_lines(v.docs)).select(
        "doc", "lineno", "text", F.array_join(F.array_sort("rsids"), ",").alias("rsids"),
        F.array_join("tokens", ",").alias("tokens"), "clinical", "has_citation", "stated_genotype",
    )


@query("claim_support", "v_docs v_calls", """
select doc, lineno, array_to_string(supporting, ',') as supporting, array_to_string(absent, ',') as absent, genotype_mismatch from d_claims""", AUDIT)
def _(v):
    c = _lineno(OE.claim_support(OD.claim_lines(v.docs), v.index))
    return c.select("doc", "lineno", F.array_join(F.array_sort("supporting"), ",").alias("supporting"),
                    F.array_join(F.array_sort("absent"), ",").alias("absent"), "genotype_mismatch")


@query("audit_claims", "v_docs v_calls", """
select doc, lineno, disposition, clinical and len(supporting) = 0 as missing_rsid_linkage, clinical and not has_citation as missing_citation from d_claims""", AUDIT)
def _(v):
    c = _lineno(jobs.audit_claims(v.docs, v.index)["claims"])
    return c.select("doc", "lineno", "disposition", "missing_rsid_linkage", "missing_citation")


@query("audit_summary", "v_docs v_calls", """
select d.disposition, count(c.doc) as n_claims from (values ('delete'), ('rewrite-with-citation'), ('keep')) d(disposition)
  left join d_claims c using (disposition) group by d.disposition""", AUDIT)
def _(v):
    return jobs.audit_claims(v.docs, v.index)["summary"]


@query("audit_totals", "v_docs", """
select (select count(*) from v_docs) as docs, (select count(*) from d_claim) as claims, (select count(*) from (
  select rsu[1] from d_claim where stated_genotype is not null group by 1 having count(distinct stated_genotype) > 1)) as contradictions""", CLAIMS)
def _(v):
    return OE.audit_totals(v.docs, OD.claim_lines(v.docs))


# Each document belongs to one of the first hundred samples.
BY_SAMPLE = CLAIMS + "," + POOL + "," + LAST_SAMPLE + r""",
idx_s as (select p.sample_id, p.rsid, coalesce(genotype, 'not_tested') as genotype,
  case when coalesce(genotype, 'not_tested') in ('', 'not_tested', '--') then 'n' else 'y' end as found
  from (select distinct 1 + doc % 100 as sample_id, rsid from d_tok) p left join c_last using (sample_id, rsid)),
d_ids as (select doc, lineno, unnest(rsu) as rsid from d_claim),
d_sup as (select doc, lineno, count(*) filter (where found = 'y') as sup, max(genotype) as gt, max(found) as fd
  from d_ids left join idx_s on idx_s.rsid = d_ids.rsid and idx_s.sample_id = 1 + d_ids.doc % 100 group by doc, lineno)"""


@query("audit_claims_by_sample", "v_docs v_calls", """
select 1 + doc % 100 as sample_id, doc, lineno, case when len(tokens) > 0 then 'delete' when clinical and coalesce(sup, 0) = 0 then 'delete'
    when coalesce(sup, 0) > 0 and not has_citation then 'rewrite-with-citation' else 'keep' end as disposition,
  case when stated_genotype is not null and fd = 'y' then stated_genotype <> case when regexp_full_match(gt, '[ACGT]{2}') then list_aggregate(list_sort(string_split(gt, '')), 'string_agg', '') else gt end end as genotype_mismatch
from d_claim left join d_sup using (doc, lineno)""", BY_SAMPLE)
def _(v):
    docs = v.docs.withColumn("sample_id", 1 + F.col("doc") % 100)
    return _lineno(jobs.audit_claims_by_sample(docs, v.calls)).select(
        "sample_id", "doc", "lineno", "disposition", "genotype_mismatch")


@query("index_for_documents", "v_docs v_calls", "select sample_id, rsid, genotype, found from idx_s", BY_SAMPLE)
def _(v):
    docs = v.docs.withColumn("sample_id", 1 + F.col("doc") % 100)
    return OE.index_for_documents(docs, v.calls).select("sample_id", "rsid", "genotype", "found")


@query("contradictions", "v_docs", """
select distinct rsu[1] as rsid, stated_genotype as genotype, doc from d_claim where stated_genotype is not null
  and rsu[1] in (select rsu[1] from d_claim where stated_genotype is not null group by 1 having count(distinct stated_genotype) > 1)""", CLAIMS)
def _(v):
    return OE.contradictions(OD.claim_lines(v.docs))


# --- consistency --------------------------------------------------------------------

TRACE = AUDIT + r""",
d_cite as (select distinct doc, unnest(regexp_extract_all(line, '\brs[0-9]+\b')) as rsid from d_s where not archive_quote and not mk)"""
TRIPLES = INDEX + r""",
tri as (select doc, regexp_extract(t, 'rs\d+') as rsid, regexp_extract(t, '(--|[ACGTDI]{1,2})`$', 1) as cited
from (select doc_id as doc, unnest(regexp_extract_all(text, '`rs\d+\s+[0-9XYMT]+:[\d,]+\s+(?:--|[ACGTDI]{1,2})`')) as t from v_docs))"""


def _half_index(v):
    """INDEX rows of the ids whose number is no multiple of three, so some citations miss it."""
    return v.index.filter(F.substr("rsid", F.lit(3)).cast("bigint") % 3 != 0)


@query("rsid_traceability", "v_docs v_calls", """
select doc, rsid, case when found is null then 'absent' else 'gap' end as status
from d_cite left join (select * from idx where cast(substr(rsid, 3) as bigint) % 3 <> 0) i using (rsid) where found is null or found <> 'y'""", TRACE)
def _(v):
    return OE.rsid_traceability(v.docs, _half_index(v))


@query("genotype_consistency", "v_docs v_calls", """
select doc, tri.rsid, cited, idx.genotype from tri join idx using (rsid) where cited <> idx.genotype""", TRIPLES)
def _(v):
    return OE.genotype_consistency(v.docs, v.index).select("doc", "rsid", "cited", "genotype")


@query("source_drift", "v_docs", """
select doc_id as doc, case when doc_id % 11 = 0 then case when doc_id % 2 = 0 then 'ABC' else 'DEF' end end as declared,
  case when doc_id % 11 <> 0 then 'undeclared' when doc_id % 2 = 0 then 'ok' else 'drift' end as status from v_docs""")
def _(v):
    return OE.source_drift(v.docs, "abc")


VERIFY = TRACE + """,
tri as (select doc, regexp_extract(t, 'rs\\d+') as rsid, regexp_extract(t, '(--|[ACGTDI]{1,2})`$', 1) as cited
from (select doc_id as doc, unnest(regexp_extract_all(text, '`rs\\d+\\s+[0-9XYMT]+:[\\d,]+\\s+(?:--|[ACGTDI]{1,2})`')) as t from v_docs)),
chk as (select 0 as ordinal, 'archive_integrity' as "check", 'skip' as status, 0::bigint as n_fail, 0::bigint as n_note
 union all select 1, 'genome_sha', null, count(*) filter (where doc_id % 11 = 0 and doc_id % 2 <> 0), count(*) filter (where doc_id % 11 <> 0) from v_docs
 union all select 2, 'provenance_coverage', null, count(*) filter (where not contains(text, '## Provenance Summary')), 0 from v_docs
 union all select 3, 'aspirational_narrow', null, count(*), 0 from d_s where not fenced and not archive_quote and not mk
   and regexp_matches(line, '(?i)may benefit|might consider|could be helpful|future possibility|patients with this variant often')
 union all select 4, 'aspirational_blacklist', null, count(*), 0 from d_hit
 union all select 5, 'rsid_traceability', null, count(*) filter (where found is null), count(*) filter (where found <> 'y') from d_cite left join idx using (rsid)
 union all select 6, 'genotype_consistency', null, count(*), 0 from tri join idx using (rsid) where cited <> idx.genotype
 union all select 7, 'continuation_prompts', 'skip', 0, 0),
chks as (select ordinal, "check", coalesce(status, case when n_fail > 0 then 'fail' else 'pass' end) as status, n_fail, n_note from chk)"""


@query("verify_corpus", "v_docs v_calls", "select * from chks", VERIFY)
def _(v):
    return jobs.verify_corpus(v.docs, v.index, live_hash="abc")


ARTIFACTS = "select 'phase' || n || '_prompt.md' as name from (values (0), (1), (2), (3), (4), (5), (6), (7)) p(n)"


@query("required_artifacts", "v_docs", f"""
select name from ({ARTIFACTS}) where name not in (select 'phase' || doc_id % 6 || '_prompt.md' from v_docs)""")
def _(v):
    names = v.docs.select(F.concat(F.lit("phase"), (F.col("doc") % 6).cast("string"), F.lit("_prompt.md")).alias("name"))
    return jobs.missing_artifacts(v.spark, names.distinct())


# With all inputs: an archive of one file a sample, one file fewer than expected, and no prompt missing.
@query("verify_corpus_all_inputs", "v_docs v_calls", """
select ordinal, "check", case when "check" = 'archive_integrity' then 'fail' when "check" = 'continuation_prompts' then 'pass' else status end as status,
  case when "check" = 'archive_integrity' then 1 else n_fail end as n_fail, n_note from chks""", VERIFY)
def _(v):
    prompts = v.docs.select(F.concat(F.lit("phase"), (F.col("doc") % 8).cast("string"), F.lit("_prompt.md")).alias("name")).distinct()
    archive = v.calls.select(F.col("sample_id").alias("path")).distinct()
    return jobs.verify_corpus(v.docs, v.index, "abc", prompts, archive, archive.count() + 1)


# Subjects by document: the first holds half of all, the others share the rest. Live hashes of two in three subjects.
VERIFY_SAMPLE = CLAIMS + "," + POOL + "," + LAST_SAMPLE + """,
dk as (select doc_id as doc, case when doc_id % 2 = 0 then 1 else 1 + doc_id % 100 end as sample_id, doc_id, text from v_docs),
s_pool as (select distinct sample_id, rsid from d_tok join dk using (doc) where cast(substr(rsid, 3) as bigint) % 3 <> 0),
idx_s as (select p.sample_id, p.rsid, coalesce(genotype, 'not_tested') as genotype,
  case when coalesce(genotype, 'not_tested') in ('', 'not_tested', '--') then 'n' else 'y' end as found from s_pool p left join c_last using (sample_id, rsid)),
live as (select distinct sample_id, case when sample_id % 3 = 0 then 'abc' else 'def' end as h from v_calls where sample_id % 3 <> 2),
d_cite as (select distinct doc, unnest(regexp_extract_all(line, '\\brs[0-9]+\\b')) as rsid from d_s where not archive_quote and not mk),
tri as (select doc, regexp_extract(t, 'rs\\d+') as rsid, regexp_extract(t, '(--|[ACGTDI]{1,2})`$', 1) as cited
  from (select doc_id as doc, unnest(regexp_extract_all(text, '`rs\\d+\\s+[0-9XYMT]+:[\\d,]+\\s+(?:--|[ACGTDI]{1,2})`')) as t from v_docs)),
f as (select sample_id, 1 as ordinal, count(*) filter (where doc % 11 = 0 and case when doc % 2 = 0 then 'abc' else 'def' end <> h) as n_fail, count(*) filter (where doc % 11 <> 0) as n_note
  from dk join live using (sample_id) group by sample_id
 union all select sample_id, 2, count(*) filter (where not contains(text, '## Provenance Summary')), 0 from dk group by sample_id
 union all select sample_id, 3, count(*), 0 from d_s join dk using (doc) where not fenced and not archive_quote and not mk
   and regexp_matches(line, '(?i)may benefit|might consider|could be helpful|future possibility|patients with this variant often') group by sample_id
 union all select sample_id, 4, count(*), 0 from d_hit join dk using (doc) group by sample_id
 union all select sample_id, 5, count(*) filter (where found is null), count(*) filter (where found <> 'y') from d_cite join dk using (doc) left join idx_s using (sample_id, rsid) group by sample_id
 union all select sample_id, 6, count(*), 0 from tri join dk using (doc) join idx_s using (sample_id, rsid) where cited <> genotype group by sample_id),
subj as (select distinct sample_id from dk),
names(ordinal, "check") as (values (0, 'archive_integrity'), (1, 'genome_sha'), (2, 'provenance_coverage'), (3, 'aspirational_narrow'), (4, 'aspirational_blacklist'), (5, 'rsid_traceability'), (6, 'genotype_consistency'), (7, 'continuation_prompts')),
r as (select subj.sample_id, names.ordinal, "check", coalesce(n_fail, 0) as n_fail, coalesce(n_note, 0) as n_note, h from subj, names left join f on f.sample_id = subj.sample_id and f.ordinal = names.ordinal left join live on live.sample_id = subj.sample_id)"""


@query("verify_corpus_by_sample", "v_docs v_calls", """
select sample_id, ordinal, "check", case when ordinal in (0, 7) or (ordinal = 1 and h is null) then 'skip' when n_fail > 0 then 'fail' else 'pass' end as status, n_fail, n_note from r""", VERIFY_SAMPLE)
def _(v):
    docs = v.docs.withColumn("sample_id", F.when(F.col("doc") % 2 == 0, F.lit(1).cast("bigint")).otherwise(1 + F.col("doc") % 100))
    index = OE.index_for_documents(docs, v.calls).filter(F.substr("rsid", F.lit(3)).cast("bigint") % 3 != 0)
    live = v.calls.select("sample_id").distinct().filter("sample_id % 3 <> 2").withColumn(
        "live_hash", F.when(F.col("sample_id") % 3 == 0, "abc").otherwise("def"))
    return jobs.verify_corpus_by_sample(docs, index, live)


@query("check_rollup", "v_docs v_calls", """
select count(*) filter (where status = 'pass') as passed, count(*) filter (where status = 'fail') as failed, count(*) filter (where status = 'skip') as skipped from chks""", VERIFY)
def _(v):
    return jobs.check_rollup(jobs.verify_corpus(v.docs, v.index, live_hash="abc"))


@query("provenance_coverage", "v_docs", "select doc_id as doc from v_docs where not contains(text, '## Provenance Summary')")
def _(v):
    return jobs.verify_items(v.docs).filter(F.col("check") == "provenance_coverage").select(
        F.col("doc").cast("bigint").alias("doc"))


# --- clinical references -------------------------------------------------------------

@query("clinvar_reference", "v_clinvar", "select rsid, pathogenic_allele, gene, vcv, significance from cv", CLINVAR)
def _(v):
    return OE.clinvar_reference(v("v_clinvar"))


@query("clinvar_skipped", "v_clinvar", "select count(*) as skipped from v_clinvar where lower(significance) not in ('pathogenic', 'likely pathogenic')")
def _(v):
    return OE.clinvar_skipped(v("v_clinvar"))


@query("cpic_reference", "v_cpic", "select gene, drug, lv as level, unnest(list_distinct(rs)) as rsid from cp_ab", CPIC)
def _(v):
    return OK.unnest(OE.cpic_reference(v("v_cpic")), ["gene", "drug", "level"], F.col("rsids"), "rsid")


@query("cpic_gene_rollup", "v_cpic", """
select distinct gene, kind, value from (select gene, 'level' as kind, lv as value from cp_ab union all select gene, 'drug', drug from cp_ab union all select gene, 'rsid', unnest(rs) from cp_ab)""", CPIC)
def _(v):
    return OE.cpic_gene_members(OE.cpic_reference(v("v_cpic")))


@query("cpic_gene_drugs", "v_cpic", """
select gene, 0::bigint as part_no, count(*) as n_values, string_agg(drug, ',' order by drug) as drugs from (select distinct gene, drug from cp_ab) group by gene""", CPIC)
def _(v):
    pairs = OE.cpic_reference(v("v_cpic")).select("gene", "drug").distinct()
    return OK.value_lists(pairs, "gene", "drug", "drugs")


@query("level_a_alerts", "v_cpic", "select gene, drug, level, defining_rsids from v_cpic where upper(trim(level)) in ('A', 'LEVEL A')")
def _(v):
    return OE.level_a_alerts(v("v_cpic"))


@query("candidate_universe", "v_clinvar v_cpic", "select rsid from cv union select rsid from cp_pairs", CPIC + "," + CLINVAR)
def _(v):
    return OE.candidate_universe(
        OE.clinvar_reference(v("v_clinvar")), OE.cpic_rsids(OE.cpic_reference(v("v_cpic"))))


def _passes(v):
    cv = OE.clinvar_reference(v("v_clinvar"))
    pairs = OE.cpic_rsids(OE.cpic_reference(v("v_cpic")))
    called = OE.found_calls(v.calls, OE.candidate_universe(cv, pairs))
    a = OE.acmg_flag(OE.clinvar_match(called, cv), GENE_PANEL)
    return called, a, OE.cpic_match(called, pairs)


USES = "v_calls v_clinvar v_cpic"


@query("clinvar_match", USES, "select sample_id, rsid, genotype, pathogenic_allele, gene, vcv, allele_matched, strand from pa", PASSES)
def _(v):
    return _passes(v)[1].select("sample_id", "rsid", "genotype", "pathogenic_allele", "gene", "vcv", "allele_matched", "strand")


@query("acmg_flag", USES, "select sample_id, rsid, gene from pa where acmg", PASSES)
def _(v):
    return _passes(v)[1].filter("acmg").select("sample_id", "rsid", "gene")


@query("cpic_match", USES, "select sample_id, rsid, genotype, cpic_gene from pc", PASSES)
def _(v):
    return _passes(v)[2].select("sample_id", "rsid", "genotype", "cpic_gene")


@query("pass_union", USES, "select * from pu", PASSES)
def _(v):
    _, a, c = _passes(v)
    return OE.pass_union(a, c)


@query("allele_match", "v_calls v_clinvar", """
select line_no, rsid, case when contains(genotype, pathogenic_allele) or contains(genotype, translate(pathogenic_allele, 'ACGT', 'TGCA')) then true else false end as matched,
  case when contains(genotype, pathogenic_allele) then 'direct' when contains(genotype, translate(pathogenic_allele, 'ACGT', 'TGCA')) then 'complement' else 'none' end as strand
from v_calls join v_clinvar using (rsid)""")
def _(v):
    j = v.calls.join(v("v_clinvar").select("rsid", "pathogenic_allele"), "rsid")
    m = j.withColumn("m", XG.allele_match(F.col("genotype"), F.col("pathogenic_allele")))
    return m.select("line_no", "rsid", "m.matched", "m.strand")


@query("drop_known", "v_docs " + USES, "select * from pu where rsid not in (select rsid from pool)", POOL + "," + PASSES)
def _(v):
    _, a, c = _passes(v)
    return OE.drop_known(OE.pass_union(a, c), OD.first_seen_pool(v.docs))


@query("net_new", "v_docs " + USES, """
select pu.*, coalesce(n, 0) as observed, coalesce(n, 0) = 0 as net_new from pu left join (select rsid, count(*) as n from d_tok group by rsid) using (rsid)""", POOL + "," + PASSES)
def _(v):
    _, a, c = _passes(v)
    return OE.net_new(OE.pass_union(a, c), v.docs)


# Ids of five shapes: plain, with a space, with a colon and a comma, with a hyphen, and one of another registry.
SHAPES = """
case p_partkey % 5 when 0 then concat('rs', cast(p_partkey as {S})) when 1 then concat('Doc ', cast(p_partkey as {S}))
  when 2 then concat(cast(1 + p_partkey % 22 as {S}), ':', cast(1 + p_partkey % 9 as {S}), ',000') when 3 then 'likely-pathogenic' else concat('VCV', lpad(cast(p_partkey % 130 as {S}), 9, '0')) end"""


@query("net_new_any_id", "v_docs", f"""
select p_partkey as part, {SHAPES.replace("{S}", "varchar").strip()} as rsid, coalesce(n, 0) as observed, coalesce(n, 0) = 0 as net_new from part left join
(select t as rsid, count(*) as n from (select unnest(regexp_extract_all(text, '\\brs[0-9]+\\b|\\bDoc [0-9]+\\b|\\b[0-9]+:[0-9],000\\b|\\blikely-pathogenic\\b|\\bVCV[0-9]+\\b')) as t from v_docs) group by t) c
on c.rsid = {SHAPES.replace("{S}", "varchar").strip()}""")
def _(v):
    rows = v.table("part").select(F.col("p_partkey").alias("part"), F.expr(SHAPES.replace("{S}", "string")).alias("rsid"))
    return OE.net_new(rows, v.docs)


KNOWN = POOL + "," + PASSES + """,
known as (select rsid from v_rsmap where cast(substr(rsid, 3) as bigint) % 2 = 0),
cand as (select pu.*, coalesce(n, 0) as observed, coalesce(n, 0) = 0 as net_new from pu left join (select rsid, count(*) as n from d_tok group by rsid) using (rsid) where rsid not in (select rsid from known))"""


def _discover(v):
    known = v("v_rsmap").filter(F.substr("rsid", F.lit(3)).cast("bigint") % 2 == 0)
    return jobs.discover_candidates(
        v.calls, known, v("v_clinvar"), v("v_cpic"), v.docs, v("v_ledger"), "2026-01-15", acmg_genes=GENE_PANEL)


ALL = "v_docs v_rsmap v_ledger " + USES


@query("discover_candidates", ALL, "select * from cand", KNOWN)
def _(v):
    return _discover(v)["candidates"]


@query("candidate_summary", ALL, """
select (select count(*) from cand) as candidates, (select count(*) from cand where net_new) as net_new, (select count(*) from called where rsid in (select rsid from known)) as dropped_phase0,
  (select count(*) from univ) as universe_size, (select count(*) from v_clinvar where lower(significance) not in ('pathogenic', 'likely pathogenic')) as clinvar_skipped,
  (select count(*) from v_cpic where upper(trim(level)) not in ('A', 'B', 'LEVEL A', 'LEVEL B')) as cpic_skipped, (select count(distinct rsid) from cv) as clinvar_rsids,
  (select count(distinct gene) from cp_ab) as cpic_ab_genes, 2::bigint as acmg_genes""", KNOWN)
def _(v):
    return _discover(v)["summary"]


@query("cpic_evidence", ALL, """
select distinct c.sample_id, c.rsid, p.gene, p.lv as level, p.drug, false as in_ledger
from called c join (select gene, drug, lv, unnest(list_distinct(rs)) as rsid from cp_ab) p using (rsid) where c.rsid not in (select rsid from known)""", KNOWN)
def _(v):
    return _discover(v)["cpic_evidence"].select("sample_id", "rsid", "gene", "level", "drug", "in_ledger")


@query("citation_ledger_join", ALL, """
select sample_id, pa.rsid, vcv, l.url, l.url_verified, l.url is not null as in_ledger from pa left join v_ledger l on l.identifier = pa.vcv where pa.rsid not in (select rsid from known)""", KNOWN)
def _(v):
    return _discover(v)["clinvar"].select("sample_id", "rsid", "vcv", "url", "url_verified", "in_ledger")


@query("extend_index", ALL, """
select rsid, chromosome, position, genotype, found, 0 as discovered_in_phase from idx
union all select rsid, any_value(chrom), cast(any_value(pos) as varchar), arg_max(genotype, sample_id), 'y', 6 from cand where rsid not in (select rsid from idx) group by rsid""",
       KNOWN + "," + INDEX.split(POOL + ",", 1)[1].replace("c_last", "c_all"))
def _(v):
    c = _discover(v)["candidates"]
    new = OE.drop_known(c, v.index).groupBy("rsid").agg(
        F.any_value("chrom").alias("chromosome"), F.any_value("pos").cast("string").alias("position"),
        F.max_by("genotype", "sample_id").alias("genotype"))
    return OE.extend_index(v.index, new)


@query("panel_gene_coverage", USES, """
select gene, count(*) as n_rsids, count(c.rsid) as n_called, count(c.rsid) > 0 as covered from cp_pairs left join (select distinct rsid from called) c using (rsid) group by gene""", PASSES)
def _(v):
    pairs = OE.cpic_rsids(OE.cpic_reference(v("v_cpic")))
    return OE.panel_gene_coverage(pairs, OE.found_calls(v.calls, pairs))


# --- citations and gates -----------------------------------------------------------------

@query("citation_gate", "v_citations", """
select citation_id, source_key, url, case when source_key = 'blog' then 'source not listed'
  when (source_key = 'pubmed' and not starts_with(url, 'https://pubmed.ncbi.nlm.nih.gov/')) or (source_key = 'clinvar' and not starts_with(url, 'https://www.ncbi.nlm.nih.gov/clinvar/'))
    or (source_key = 'dbsnp' and not starts_with(url, 'https://www.ncbi.nlm.nih.gov/snp/')) then 'url outside source root' end as reason from v_citations""")
def _(v):
    return OE.citation_gate(v("v_citations"), OE.citation_sources(v.spark))


@query("citation_url", "v_clinvar", """
select vcv, 'https://www.ncbi.nlm.nih.gov/clinvar/variation/' || substr(vcv, 4) || '/' as url, replace(vcv || ' (' || gene || ')', ' ', '_') as raw,
  regexp_replace(vcv || ' (' || gene || ')', '[^A-Za-z0-9._-]', '_', 'g') || '_20260115' as ledger_key from v_clinvar""")
def _(v):
    ident = F.concat("vcv", F.lit(" ("), "gene", F.lit(")"))
    return v("v_clinvar").select(
        "vcv", XE.citation_url(F.lit(K.CITATION_SOURCES[1][1]), F.col("vcv")).alias("url"),
        F.replace(ident, F.lit(" "), F.lit("_")).alias("raw"),
        XE.ledger_key(ident, F.lit("2026-01-15").cast("date")).alias("ledger_key"),
    )


def _findings(v):
    part = v.table("part")
    triple = F.struct(F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("rs"), F.col("p_partkey").cast("string"))).alias("rsid"))
    cite = F.struct(F.lit("clinvar").alias("source_key"))
    none = lambda s: F.filter(F.array(s), lambda x: F.lit(False))
    return part.select(
        F.col("p_partkey").alias("finding_id"), F.col("p_brand").alias("doc_id"),
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand")).otherwise(F.lit(" ")).alias("gene"),
        F.col("p_name").alias("name"), (F.col("p_size") % 5).alias("tier"), F.lit("CPIC Level A").alias("evidence"),
        F.col("p_type").alias("implication"),
        F.when(F.col("p_partkey") % 4 != 0, F.array(triple)).otherwise(none(triple)).alias("triples"),
        F.when(F.col("p_partkey") % 6 != 0, F.array(cite)).otherwise(none(cite)).alias("citations"),
    )


@query("finding_gate", "", """
select p_partkey as finding_id, concat_ws('; ', case when p_partkey % 10 = 0 then 'missing gene' end, case when p_size % 5 not between 1 and 3 then 'tier not 1-3' end,
  case when p_partkey % 4 = 0 then 'no triple' end, case when p_partkey % 4 <> 0 and p_partkey % 9 = 0 then 'triple without rsid' end, case when p_partkey % 6 = 0 then 'no citation' end) as reasons from part""")
def _(v):
    return OG.finding_gate(_findings(v)).select("finding_id", F.array_join("reasons", "; ").alias("reasons"))


@query("claim_gate", "v_docs", """
select doc, lineno, concat_ws('; ', case when clinical and len(rsu) = 0 then 'clinical claim without rsid' end, case when clinical and not has_citation then 'clinical claim without citation' end) as reasons from d_claim""", CLAIMS)
def _(v):
    c = _lineno(OD.claim_lines(v.docs))
    c = c.withColumns({
        "rsid": F.get("rsids", F.lit(0)),
        "citation_keys": F.when(F.col("has_citation"), F.array(F.lit("cited"))).otherwise(XT.no_strings()),
    })
    return OG.claim_gate(c).select("doc", "lineno", F.array_join("reasons", "; ").alias("reasons"))


@query("alert_gate", "", """
select s_suppkey as alert_id, case when s_suppkey % 3 = 0 then 'missing recommendation' else '' end as reasons from supplier""")
def _(v):
    a = v.table("supplier").select(
        F.col("s_suppkey").alias("alert_id"), F.col("s_name").alias("drug"), F.lit("GENE1 *2/*2").alias("gene_genotype"),
        F.lit("CPIC Level A").alias("evidence"), F.when(F.col("s_suppkey") % 3 != 0, F.lit("avoid")).alias("recommendation"))
    return OG.alert_gate(a).select("alert_id", F.array_join("reasons", "; ").alias("reasons"))


@query("provenance_gate", "", """
select o_orderkey as block_id, concat_ws('; ', case when o_custkey % 5 = 0 then 'missing produced_by' end, case when o_orderkey % 7 = 0 then 'missing source_genome_assembly' end,
  case when o_orderkey % 9 > 7 then 'phase not 0-7' end, case when o_orderkey % 7 = 1 then 'unknown assembly' end) as reasons from orders""")
def _(v):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.lit("x")
    b = v.table("orders").select(
        k.alias("block_id"), text.alias("doc_id"), F.when(c % 5 != 0, text).alias("produced_by"),
        F.col("o_orderdate").cast("date").alias("produced_on"), (k % 9).alias("phase"), text.alias("source_genome_path"),
        text.alias("source_genome_sha256"),
        F.when(k % 7 == 0, F.lit("")).when(k % 7 == 1, F.lit("hg18")).otherwise(F.lit("GRCh37")).alias("source_genome_assembly"),
        c.alias("source_genome_line_count_verified"), text.alias("genotype_index_path"), text.alias("genotype_index_sha256"),
        F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("string").alias("supersedes_sha256"),
        F.lit(0).alias("removed_claims_count"), F.lit(0).alias("added_claims_count"),
        F.array(text).alias("external_sources_used"), F.col("o_orderdate").cast("date").alias("external_sources_access_date"))
    return OG.provenance_gate(b).select("block_id", F.array_join("reasons", "; ").alias("reasons"))


@query("tier_counts", "", """
select p_brand as doc_id, count(*) as all_tiers, count(*) filter (where p_size % 5 = 1) as tier_1, count(*) filter (where p_size % 5 = 2) as tier_2, count(*) filter (where p_size % 5 = 3) as tier_3 from part group by 1""")
def _(v):
    return OG.tier_counts(_findings(v))


@query("docs_per_group", "", "select lang as \"group\", count(*) as n_docs from documents group by 1")
def _(v):
    return OG.docs_per_group(v.table("documents").select(F.col("lang").alias("group")))


@query("cross_reference_check", "", """
select o_orderkey as doc_no, case o_orderkey % 4 when 1 then './missing' || o_orderkey || '.md#body' when 2 then './' || o_orderkey || '.md#nowhere' else '/abs.md' end as target,
  case o_orderkey % 4 when 1 then 'file not found' when 2 then 'anchor not found' else 'not a relative link' end as reason from orders where o_orderkey % 4 <> 0""")
def _(v):
    k = F.col("o_orderkey").cast("string")
    link = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("./"), k, F.lit(".md#order-notes")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("./missing"), k, F.lit(".md#body")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("./"), k, F.lit(".md#nowhere")))
        .otherwise(F.lit("/abs.md"))
    )
    docs = v.table("orders").select(
        F.concat(k, F.lit(".md")).alias("doc"),
        F.concat(F.lit("# Doc\n## Order Notes\nsee [doc]("), link, F.lit(")\n")).alias("text"))
    return OE.cross_reference_check(docs).select(
        F.regexp_extract("doc", r"^(\d+)", 1).cast("bigint").alias("doc_no"), "target", "reason")
