"""The composite jobs: truth index, claim audit, candidate discovery, corpus verification,
read and variant reports, site maps. Each returns lazy DataFrames; sinks decide what is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import corpus as C
from ..operators import evidence as E
from ..operators import sequences as S
from ..operators import variants as V
from ..operators.calls import calls_summary
from ..operators.gates import phrase_gate
from ..session import fixed_rows
from ..sources import formats as R
from ..sources import lines as L


def build_truth_index(docs: DataFrame, calls: DataFrame, files: DataFrame | None = None,
                      key: str = "doc") -> dict[str, DataFrame]:
    """``index`` (pool order is ``first_doc, first_pos``), ``sources`` (rsid, doc pairs),
    ``coverage`` and ``gaps``. With ``files`` (path, format, assembly) the two stop rules hold:
    an input that is no consumer export, or names no assembly, fails the job."""
    if files is not None:
        is_calls = F.coalesce(F.col("format").startswith("consumer_dna:"), F.lit(False))
        checked = files.select(
            "path",
            F.when(~is_calls, F.raise_error(F.concat(F.lit("not a consumer export: "), "path")))
            .when(F.col("assembly").isNull(),
                  F.raise_error(F.concat(F.lit("no assembly in the header of "), "path")))
            .otherwise(F.lit(True)).alias("_ok"),
        )
        calls = calls.join(checked.filter("_ok").select("path"), "path", "left_semi")
    pool = C.first_seen_pool(docs, key)
    index = E.index_join(pool, calls)
    sources = C.citing_docs(docs, key)
    return {
        "index": index,
        "sources": sources,
        "coverage": E.index_coverage(index),
        "gaps": E.index_gaps(index, sources),
    }


def audit_claims(docs: DataFrame, index: DataFrame, phrases=K.HEDGE_PHRASES, project_terms=(),
                 key: str = "doc") -> dict[str, DataFrame]:
    """``claims`` with disposition, ``summary`` per disposition, ``contradictions``."""
    lines = C.claim_lines(docs, phrases, project_terms, key)
    claims = E.dispose(E.claim_support(lines, index, key))
    return {
        "claims": claims,
        "summary": E.audit_summary(claims),
        "contradictions": E.contradictions(lines, key),
    }


def audit_claims_by_sample(docs: DataFrame, calls: DataFrame, phrases=K.HEDGE_PHRASES, project_terms=(),
                           key: str = "doc", group: str = "sample_id") -> DataFrame:
    """``group, key`` and the columns of ``claims``: every document is audited against the calls of its own
    subject. ``docs``: ``group, key, text``; a document of a subject without calls finds none of its ids."""
    unit = docs.select(F.struct(group, key).alias("_unit"), "text")
    index = E.index_for_documents(docs, calls, key, group)
    lines = C.claim_lines(unit, phrases, project_terms, "_unit")
    return E.dispose(E.claim_support(lines, index, "_unit", group)).select(f"_unit.{group}", f"_unit.{key}", "*").drop("_unit")


def discover_candidates(calls: DataFrame, index: DataFrame, clinvar: DataFrame | None,
                        cpic: DataFrame | None, reference_docs: DataFrame,
                        ledger: DataFrame | None = None, snapshot_date: str | None = None,
                        keys=("sample_id", "rsid"), acmg_genes=K.ACMG_GENES) -> dict[str, DataFrame]:
    """Net-new clinical candidates.

    ``candidates`` has one row per key with its passes; the evidence stays in long tables
    (``clinvar``, ``cpic``) so that an id with much evidence is many rows and not one large one.
    """
    if clinvar is None and cpic is None:
        raise ValueError("needs at least one of clinvar and cpic")
    spark = calls.sparkSession
    empty_cv = "rsid string, pathogenic_allele string, gene string, vcv string, significance string"
    cv = E.clinvar_reference(clinvar) if clinvar is not None else spark.createDataFrame([], empty_cv)
    ab = E.cpic_reference(cpic) if cpic is not None else None
    pairs = E.cpic_rsids(ab) if ab is not None else spark.createDataFrame([], "rsid string, gene string")
    universe = E.candidate_universe(cv, pairs)
    called = E.found_calls(calls, universe, keys)
    fresh = E.drop_known(called, index)
    a = E.acmg_flag(E.clinvar_match(fresh, cv), acmg_genes)
    c = E.cpic_match(fresh, pairs)
    candidates = E.net_new(E.pass_union(a, c, keys), reference_docs, universe)
    clinvar_rows = a
    if ledger is not None:
        cited = a.withColumns({
            "source_key": F.lit("clinvar"), "identifier": F.col("vcv"),
            "snapshot_date": F.lit(snapshot_date).cast("date"),
        })
        clinvar_rows = E.citation_ledger_join(cited, ledger)
    one = F.lit(1).alias("_k")
    known = called.join(index.select("rsid"), "rsid", "left_semi")
    none = spark.sql("select 0L as skipped")
    skipped = (E.clinvar_skipped(clinvar) if clinvar is not None else none).select(
        F.col("skipped").alias("clinvar_skipped"), one)
    cpic_skipped = (E.cpic_skipped(cpic) if cpic is not None else none).select(
        F.col("skipped").alias("cpic_skipped"), one)
    # The scope of the scan: distinct ids and genes of the references.
    scope = cv.agg(F.count_distinct("rsid").alias("clinvar_rsids"), one).join(
        (ab if ab is not None else pairs).agg(F.count_distinct("gene").alias("cpic_ab_genes"), one), "_k")
    summary = candidates.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("net_new").alias("net_new"), one
    ).join(known.agg(F.count(F.lit(1)).alias("dropped_phase0"), one), "_k").join(
        universe.agg(F.count(F.lit(1)).alias("universe_size"), one), "_k").join(skipped, "_k").join(
        cpic_skipped, "_k").join(scope, "_k").withColumn("acmg_genes", F.lit(len(set(acmg_genes))).cast("bigint")).drop("_k")
    out = {"candidates": candidates, "clinvar": clinvar_rows, "cpic": c, "summary": summary}
    if ab is not None:
        out["cpic_members"] = E.cpic_gene_members(ab)
        evidence = E.cpic_evidence(fresh, ab)
        if ledger is not None:
            evidence = E.citation_ledger_join(
                evidence.withColumn("snapshot_date", F.lit(snapshot_date).cast("date")), ledger)
        out["cpic_evidence"] = evidence
    return out


CHECKS = (
    "archive_integrity", "genome_sha", "provenance_coverage", "aspirational_narrow",
    "aspirational_blacklist", "rsid_traceability", "genotype_consistency", "continuation_prompts",
)


def _with_truth(found: DataFrame, index: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """Findings with the INDEX row of the id they cite (``_found, _gt``), in one join. Rows that cite no id get
    a key that no rsID equals and that differs by row, so they spread over the reducers and match nothing."""
    kind = F.col("kind")
    truth = index.select(*([F.col(group).alias("_group")] if group else []), F.col("rsid").alias("_rsid"),
                         F.col("found").alias("_found"), F.col("genotype").alias("_gt"))
    spread_null = F.concat_ws(":", F.col(key).cast("string"), F.col("lineno").cast("string"))
    cited = F.when(kind.isin("rsid", "triple"), F.col("value")).otherwise(spread_null)
    same = F.col("_cited") == F.col("_rsid")
    if group:
        same = same & (F.col(group) == F.col("_group"))
    return found.withColumn("_cited", cited).join(truth, same, "left")


def _judged(found: DataFrame, names) -> DataFrame:
    """``check, severity, *names, item`` of the findings that are none of the good ones."""
    kind = F.col("kind")
    check = F.expr("""case kind when 'no_summary' then 'provenance_coverage'
        when 'narrow' then 'aspirational_narrow' when 'phrase' then 'aspirational_blacklist'
        when 'hash' then 'genome_sha' when 'rsid' then 'rsid_traceability'
        when 'triple' then 'genotype_consistency' end""")
    ok = (
        ((kind == "rsid") & (F.coalesce("_found", F.lit("")) == "y"))
        | ((kind == "triple") & (F.col("_gt").isNull() | (F.col("detail") == F.col("_gt"))))
    )
    note = ((kind == "hash") & (F.col("value") == "undeclared")) | (
        (kind == "rsid") & F.col("_found").isNotNull())
    item = F.concat_ws(" ", F.col("lineno").cast("string"), "value", "detail", "_gt")
    return found.filter(~ok).select(
        check.alias("check"), F.when(note, F.lit("note")).otherwise(F.lit("fail")).alias("severity"),
        *names, item.alias("item"))


def verify_items(docs: DataFrame, index: DataFrame | None = None, live_hash: str | None = None,
                 prompt_names: DataFrame | None = None, phrases=K.HEDGE_PHRASES,
                 key: str = "doc") -> DataFrame:
    """Long table ``check, severity (fail or note), doc, item`` of everything the checks found."""
    found = C.doc_findings(docs, phrases, live_hash, key)
    kind = F.col("kind")
    if index is None:
        found = found.filter(~kind.isin("rsid", "triple")).withColumns(
            {"_found": F.lit(None).cast("string"), "_gt": F.lit(None).cast("string")})
    else:
        found = _with_truth(found, index, key)
    out = _judged(found, [F.col(key).cast("string").alias("doc")])
    if prompt_names is not None:
        gone = missing_artifacts(docs.sparkSession, prompt_names)
        out = out.unionByName(gone.select(
            F.lit("continuation_prompts").alias("check"), F.lit("fail").alias("severity"),
            F.lit(None).cast("string").alias("doc"), F.col("name").alias("item")))
    return out


def missing_artifacts(spark: SparkSession, names: DataFrame, expected=K.CONTINUATION_PROMPTS) -> DataFrame:
    """Expected file names that a listing ``name`` does not hold."""
    want = fixed_rows(spark, [(n,) for n in expected], "name string")
    return want.join(names.select("name"), "name", "left_anti")


def verify_corpus(docs: DataFrame, index: DataFrame | None = None, live_hash: str | None = None,
                  prompt_names: DataFrame | None = None, archive_files: DataFrame | None = None,
                  expected_archive_count: int | None = None, phrases=K.HEDGE_PHRASES,
                  key: str = "doc") -> DataFrame:
    """One row per check: ``check, status (pass, fail, skip), n_fail, n_note``. A check without
    its input is skipped. The findings themselves are in ``verify_items``."""
    spark = docs.sparkSession
    items = verify_items(docs, index, live_hash, prompt_names, phrases, key)
    n_fail, n_note = F.count_if(F.col("severity") == "fail"), F.count_if(F.col("severity") == "note")
    counts = items.groupBy("check").agg(n_fail.alias("n_fail"), n_note.alias("n_note"))
    if archive_files is not None:
        n = F.count(F.lit(1))
        wrong = F.lit(0) if expected_archive_count is None else (n != expected_archive_count).cast("int")
        counts = counts.unionByName(archive_files.agg(
            F.lit("archive_integrity").alias("check"), wrong.cast("bigint").alias("n_fail"),
            F.lit(0).cast("bigint").alias("n_note"),
        ).select("check", "n_fail", "n_note"))
    given = {
        "archive_integrity": archive_files is not None, "genome_sha": live_hash is not None,
        "rsid_traceability": index is not None, "genotype_consistency": index is not None,
        "continuation_prompts": prompt_names is not None,
    }
    plan = fixed_rows(
        spark, [(i, c, given.get(c, True)) for i, c in enumerate(CHECKS)], "ordinal int, check string, given boolean"
    )
    j = plan.join(counts, "check", "left")
    zero = F.lit(0).cast("bigint")
    status = F.when(~F.col("given"), F.lit("skip")).when(
        F.coalesce("n_fail", zero) > 0, F.lit("fail")
    ).otherwise(F.lit("pass"))
    return j.select(
        "ordinal", "check", status.alias("status"),
        F.coalesce("n_fail", zero).alias("n_fail"), F.coalesce("n_note", zero).alias("n_note"),
    )


def verify_items_by_sample(docs: DataFrame, index: DataFrame, live: DataFrame | None = None,
                           phrases=K.HEDGE_PHRASES, key: str = "doc", group: str = "sample_id") -> DataFrame:
    """``verify_items`` of documents of many subjects: ``check, severity, group, doc, item``, each document against
    its own subject's INDEX rows and live hash. ``docs``: ``group, key, text``; ``index``: ``group, rsid, found,
    genotype``; ``live``: ``group, live_hash``, at most one row a subject. A null subject has no INDEX rows."""
    rows = docs.select(group, key, "text")
    rows = rows.withColumn("_live", F.lit(None).cast("string")) if live is None else rows.join(
        live.select(group, F.col("live_hash").alias("_live")), group, "left")
    unit = rows.select(F.struct(group, key).alias("_unit"), "text", "_live")
    found = C.doc_findings(unit, phrases, None, "_unit", "_live").withColumn(group, F.col(f"_unit.{group}"))
    return _judged(_with_truth(found, index, "_unit", group), [group, F.col(f"_unit.{key}").cast("string").alias("doc")])


def verify_corpus_by_sample(docs: DataFrame, index: DataFrame, live: DataFrame | None = None,
                            prompt_names: DataFrame | None = None, archive_files: DataFrame | None = None,
                            expected_archive: DataFrame | None = None, phrases=K.HEDGE_PHRASES,
                            key: str = "doc", group: str = "sample_id") -> DataFrame:
    """``verify_corpus`` for every subject that has documents: ``group, ordinal, check, status, n_fail, n_note``.

    Besides ``verify_items_by_sample``'s inputs, ``prompt_names``: ``group, name``; ``archive_files``: ``group,
    path``; ``expected_archive``: ``group, expected``. ``genome_sha`` is skipped for a subject without a live
    hash, ``archive_integrity`` fails where the number of files is another than expected (a subject without a
    number passes). Subjects are compared null-safely, so documents of no subject are a subject of their own.
    """
    spark = docs.sparkSession
    zero = F.lit(0).cast("bigint")
    subjects = docs.select(group).distinct()
    counts = verify_items_by_sample(docs, index, live, phrases, key, group).groupBy(group, "check").agg(
        F.count_if(F.col("severity") == "fail").alias("n_fail"), F.count_if(F.col("severity") == "note").alias("n_note"))

    def add(failures, check):
        return counts.unionByName(failures.select(group, F.lit(check).alias("check"), F.col("n_fail").cast("bigint").alias("n_fail"),
                                                  zero.alias("n_note")))

    if prompt_names is not None:
        wanted = fixed_rows(spark, [(n,) for n in K.CONTINUATION_PROMPTS], "name string")
        there = prompt_names.join(wanted, "name", "left_semi").groupBy(group).agg(F.count_distinct("name").alias("_n"))
        counts = add(_null_safe(subjects, there, group).withColumn(
            "n_fail", F.lit(len(K.CONTINUATION_PROMPTS)) - F.coalesce("_n", zero)), "continuation_prompts")
    if archive_files is not None and expected_archive is not None:
        n = archive_files.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
        both = _null_safe(_null_safe(subjects, n, group), expected_archive.select(group, "expected"), group)
        counts = add(both.withColumn("n_fail", F.coalesce((F.coalesce("_n", zero) != F.col("expected")).cast("int"), F.lit(0))),
                     "archive_integrity")
    given = {"archive_integrity": archive_files is not None, "continuation_prompts": prompt_names is not None}
    checks = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("check"), F.lit(given.get(c, True)).alias("given"))
                       for i, c in enumerate(CHECKS)])
    has_live = subjects.withColumn("_has", F.lit(False)) if live is None else _null_safe(
        subjects, live.select(group, F.col("live_hash").isNotNull().alias("_has")), group)
    plan = has_live.select(group, "_has", F.explode(checks).alias("_c")).select(
        group, "_c.*", F.coalesce("_has", F.lit(False)).alias("_has"))
    j = _null_safe(plan, counts, group, "check")
    status = F.when(~F.col("given") | ((F.col("check") == "genome_sha") & ~F.col("_has")), F.lit("skip")).when(
        F.coalesce("n_fail", zero) > 0, F.lit("fail")).otherwise(F.lit("pass"))
    return j.select(group, "ordinal", "check", status.alias("status"), F.coalesce("n_fail", zero).alias("n_fail"),
                    F.coalesce("n_note", zero).alias("n_note"))


def _null_safe(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join on keys of which nulls equal each other; the right keys are dropped."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(r, same, "left").drop(*[f"_r_{k}" for k in keys])


def check_rollup(checks: DataFrame) -> DataFrame:
    return checks.agg(*[F.count_if(F.col("status") == s).alias(n)
                        for s, n in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))])


def qc_report_tables(reads: DataFrame, group: str = "path") -> dict[str, DataFrame]:
    """All tables of the report, from reads that are stored once for them."""
    reads = S.stored_reads(reads, group)
    return {
        "encoding": S.quality_range(reads, group),
        "totals": S.qc_totals(reads, group),
        "per_base_quality": S.qc_per_base_box(reads, group=group),
        "read_quality": S.qc_read_quality_hist(reads, group),
        "length": S.qc_length_hist(reads, group),
        "gc": S.qc_gc_hist(reads, group),
        "n_content": S.qc_n_content(reads, group),
        "overrepresented": S.overrepresented(reads, group=group, stored=True),
    }


def variant_report_tables(variants: DataFrame) -> dict[str, DataFrame]:
    return {
        "summary": V.variant_report_counts(variants),
        "by_chromosome": V.variants_by_chrom(variants),
        "top_quality": V.top_quality(variants),
        "frameshift_candidates": V.frameshift_candidates(variants),
        "filtered_out": V.filtered_out(variants),
    }


def build_site_map(manifests: list[DataFrame], dbsnp_sites: DataFrame) -> dict[str, DataFrame]:
    """``sites`` on any of the chips, and the ``coverage`` of their union."""
    chip = V.chip_union(*manifests)
    sites = V.chip_sites(dbsnp_sites, chip)
    return {"sites": sites, "coverage": V.chip_coverage(sites, chip)}


def publishable(docs: DataFrame, phrases=K.HEDGE_PHRASES, key: str = "doc") -> DataFrame:
    return phrase_gate(docs, phrases, key)[0]


def export_summary(spark, path, **options) -> DataFrame:
    """Per genotype export: ``path, vendor, build, snp_count, no_calls, no_call_rate``. The build comes from the file's
    head and is null where that names none; files that hold no call have no row."""
    facts = R.export_facts(spark, path, **options).select(L.plain_path("path").alias("path"), "vendor", F.col("assembly").alias("build"))
    counts = calls_summary(R.read_calls(spark, path, **options), "path").withColumn("path", L.plain_path("path"))
    return counts.join(facts, "path").select("path", "vendor", "build", "snp_count", "no_calls", "no_call_rate")


def vcf_summary(spark, path, **options) -> DataFrame:
    """Per VCF file the counts of ``variant_summary`` and the ``samples`` of its header, in order."""
    header = R.vcf_header(spark, path, **options).select("path", "samples")
    return V.variant_summary(R.read_vcf(spark, path, **options), ["path"]).join(header, "path", "left").withColumn(
        "samples", F.coalesce("samples", F.array().cast("array<string>")))
