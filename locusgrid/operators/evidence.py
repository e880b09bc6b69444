"""Truth index, claim support, clinical reference passes, consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import evidence as E
from ..functions import genotype as G
from ..functions import text as T
from ..session import fixed_rows
from . import corpus
from .keyed import last_wins, prefilter, unnest


# --- truth index -----------------------------------------------------------

def index_join(pool: DataFrame, calls: DataFrame, subject: str | None = None) -> DataFrame:
    """INDEX rows of one subject: every pool rsID with its last call, ``not_tested`` if none.
    ``calls`` holds the subject's export(s); ``subject`` picks one sample of a cohort."""
    if subject is not None:
        calls = calls.filter(F.col("sample_id") == subject)
    wanted = prefilter(calls, pool, "rsid")
    last = last_wins(wanted.select("rsid", "chrom", "pos", "genotype", "line_no"), ["rsid"])
    j = pool.join(last, "rsid", "left")
    genotype = F.coalesce("genotype", F.lit(K.NOT_TESTED))
    return j.select(
        *[c for c in pool.columns],
        F.coalesce("chrom", F.lit("")).alias("chromosome"),
        F.coalesce(F.col("pos").cast("string"), F.lit("")).alias("position"),
        genotype.alias("genotype"),
        G.genotype_found(genotype).alias("found"),
        F.lit(0).alias("discovered_in_phase"),
    )


def index_by_sample(pool: DataFrame, calls: DataFrame, group: str = "sample_id") -> DataFrame:
    """Cohort form: one row per sample and pool rsID that the sample's export holds."""
    wanted = prefilter(calls, pool, "rsid")
    last = last_wins(
        wanted.select(group, "rsid", "chrom", "pos", "genotype", "line_no"), [group, "rsid"]
    )
    return last.join(pool.select("rsid"), "rsid", "left_semi").select(
        group, "rsid", F.col("chrom").alias("chromosome"), F.col("pos").alias("position"),
        "genotype", G.genotype_found(F.col("genotype")).alias("found"),
    )


def index_for_documents(docs: DataFrame, calls: DataFrame, key: str = "doc", group: str = "sample_id") -> DataFrame:
    """INDEX rows of many subjects with documents of their own: every id that a subject's documents cite,
    with that subject's last call, ``not_tested`` if none. ``docs``: ``group, key, text``."""
    cited = unnest(docs, [group], T.extract_rsids(F.col("text")), "rsid").distinct()
    wanted = prefilter(calls, cited, [group, "rsid"])
    last = last_wins(wanted.select(group, "rsid", "chrom", "pos", "genotype", "line_no"), [group, "rsid"])
    genotype = F.coalesce("genotype", F.lit(K.NOT_TESTED))
    return cited.join(last, [group, "rsid"], "left").select(
        group, "rsid", F.coalesce("chrom", F.lit("")).alias("chromosome"),
        F.coalesce(F.col("pos").cast("string"), F.lit("")).alias("position"), genotype.alias("genotype"),
        G.genotype_found(genotype).alias("found"), F.lit(0).alias("discovered_in_phase"))


def sample_coverage(sample_index: DataFrame, pool: DataFrame, group: str = "sample_id") -> DataFrame:
    """Per sample: pool size, found, present without a call, not tested."""
    per = sample_index.groupBy(group).agg(
        F.count_if(F.col("found") == "y").alias("found"),
        F.count_if(F.col("found") == "n").alias("no_call"),
    ).withColumn("_k", F.lit(1))
    size = pool.agg(F.count(F.lit(1)).alias("pool_size"), F.lit(1).alias("_k"))
    return per.join(size, "_k").select(
        group, "pool_size", "found", "no_call",
        (F.col("pool_size") - F.col("found") - F.col("no_call")).alias("not_tested"),
    )


def index_coverage(index: DataFrame) -> DataFrame:
    found = F.col("found") == "y"
    return index.agg(
        F.count(F.lit(1)).alias("cited"), F.count_if(found).alias("found"),
        F.count_if(~found).alias("not_found"),
    )


def index_gaps(index: DataFrame, citing: DataFrame) -> DataFrame:
    """``rsid, genotype, doc`` for every cited id without a call."""
    gaps = index.filter(F.col("found") == "n").select("rsid", "genotype")
    return citing.join(gaps, "rsid")


def extend_index(index: DataFrame, candidates: DataFrame) -> DataFrame:
    """INDEX rows with their phase filled in, plus the candidate rows of phase 6."""
    cols = ["rsid", "chromosome", "position", "genotype", "found", "discovered_in_phase"]
    base = index.withColumn(
        "discovered_in_phase", F.coalesce("discovered_in_phase", F.lit(0))
    ).select(*cols)
    new = candidates.select(
        "rsid", "chromosome", "position", "genotype", F.lit("y").alias("found"),
        F.lit(6).alias("discovered_in_phase"),
    )
    return base.unionByName(new)


# --- claims ----------------------------------------------------------------

DISPOSITIONS = ("delete", "rewrite-with-citation", "keep")


def claim_support(claims: DataFrame, index: DataFrame, key: str = "doc", subject: str | None = None) -> DataFrame:
    """Claims with ``supporting`` (found in the INDEX) and ``absent`` (not in the INDEX) ids in
    text order, and the tri-state ``genotype_mismatch``.

    Every id of a claim meets the INDEX as a row of its own and the rows regroup by line, so the
    documents are read once and a much-cited id is spread over the lines that cite it. A claim
    without ids travels under a key of its own that no rsID equals. With ``subject``, the key is a
    struct that has it as a field, and a claim only meets the INDEX rows of its subject.
    """
    carried = F.struct(*[c for c in claims.columns if c not in (key, "lineno")])
    own_key = F.concat_ws(":", F.col(key).cast("string"), F.col("lineno").cast("string"))
    # The line's own columns ride on its first row only: a line full of ids is not copied per id.
    ids = claims.select("*", F.posexplode_outer("rsids").alias("pos", "_id")).select(
        key, "lineno", F.when(F.coalesce("pos", F.lit(0)) == 0, carried).alias("_claim"),
        "pos", "_id", F.coalesce("_id", own_key).alias("_rsid"),
        (F.lit(0) if subject is None else F.col(key)[subject]).alias("_subject"))
    truth = index.select(
        (F.lit(0) if subject is None else F.col(subject)).alias("_subject"), F.col("rsid").alias("_rsid"), F.col("genotype").alias("_gt"), F.col("found").alias("_found"))
    met = F.struct("pos", F.col("_id").alias("rsid"), "_found", "_gt")
    on = ["_rsid"] if subject is None else ["_rsid", "_subject"]
    j = ids.join(truth, on, "left").groupBy(key, "lineno").agg(
        F.any_value("_claim", True).alias("_claim"),
        F.sort_array(F.collect_list(F.when(F.col("_id").isNotNull(), met))).alias("_ids"),
    ).select(key, "lineno", "_claim.*", "_ids")
    only = F.get("_ids", F.lit(0))
    mismatch = F.when(
        F.col("stated_genotype").isNotNull() & (only["_found"] == "y"),
        F.col("stated_genotype") != G.norm_genotype(only["_gt"]),
    )
    return j.withColumns({
        "supporting": F.transform(F.filter("_ids", lambda x: x["_found"] == "y"), lambda x: x["rsid"]),
        "absent": F.transform(F.filter("_ids", lambda x: x["_found"].isNull()), lambda x: x["rsid"]),
        "genotype_mismatch": mismatch,
    }).drop("_ids")


def dispose(supported: DataFrame) -> DataFrame:
    """Adds the provisional disposition and the two "missing" flags."""
    backed = F.size("supporting") > 0
    cited = F.col("has_citation")
    disposition = (
        F.when(F.size("tokens") > 0, F.lit("delete"))
        .when(F.col("clinical") & ~backed, F.lit("delete"))
        .when(backed & ~cited, F.lit("rewrite-with-citation"))
        .otherwise(F.lit("keep"))
    )
    return supported.withColumns({
        "missing_rsid_linkage": F.col("clinical") & ~backed,
        "missing_citation": F.col("clinical") & ~cited,
        "disposition": disposition,
    })


def contradictions(claims: DataFrame, key: str = "doc") -> DataFrame:
    """``rsid, genotype, doc`` for ids stated with two or more different genotypes."""
    stated = claims.filter(F.col("stated_genotype").isNotNull()).select(
        F.get("rsids", F.lit(0)).alias("rsid"), F.col("stated_genotype").alias("genotype"),
        F.col(key).alias("doc"),
    ).distinct()
    split = stated.groupBy("rsid").agg(
        F.min("genotype").alias("_a"), F.max("genotype").alias("_b")
    ).filter(F.col("_a") != F.col("_b"))
    return stated.join(split.select("rsid"), "rsid", "left_semi")


def audit_summary(claims: DataFrame) -> DataFrame:
    """Claims by disposition; a disposition without claims counts zero."""
    every = fixed_rows(claims.sparkSession, [(d,) for d in DISPOSITIONS], "disposition string")
    counts = claims.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "disposition", "left").select(
        "disposition", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_claims"))


def audit_totals(docs: DataFrame, claims: DataFrame, contradicted: DataFrame | None = None, key: str = "doc") -> DataFrame:
    """One row: documents read, claims, and contradicted ids: those of ``contradicted``, or else found in the pass that
    counts the claims."""
    one = F.lit(1).alias("_k")
    n_docs = docs.agg(F.count(F.lit(1)).alias("docs"), one)
    if contradicted is not None:
        return (n_docs.join(claims.agg(F.count(F.lit(1)).alias("claims"), one), "_k")
                .join(contradicted.agg(F.count_distinct("rsid").alias("contradictions"), one), "_k").drop("_k"))
    stated = F.col("stated_genotype")
    by_id = claims.groupBy(F.when(stated.isNotNull(), F.get("rsids", F.lit(0))).alias("rsid")).agg(
        F.count(F.lit(1)).alias("n"), (F.min(stated) != F.max(stated)).alias("differs"))
    totals = by_id.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("claims"),
                       F.count_if(F.col("rsid").isNotNull() & F.col("differs")).alias("contradictions"), one)
    return n_docs.join(totals, "_k").drop("_k")


# --- clinical references ---------------------------------------------------

def clinvar_reference(clinvar: DataFrame) -> DataFrame:
    """Pathogenic and likely pathogenic rows, fields trimmed."""
    cols = ("rsid", "pathogenic_allele", "gene", "vcv", "significance")
    return clinvar.filter(E.is_pathogenic(F.col("significance"))).select(
        *[T.strip(F.col(c)).alias(c) for c in cols]
    )


def clinvar_skipped(clinvar: DataFrame) -> DataFrame:
    return clinvar.agg(F.count_if(~F.coalesce(E.is_pathogenic(F.col("significance")), F.lit(False))).alias("skipped"))


def cpic_skipped(cpic: DataFrame) -> DataFrame:
    """Rows that are neither level A nor B."""
    return cpic.agg(F.count_if(E.norm_level(F.col("level")).isNull()).alias("skipped"))


def cpic_reference(cpic: DataFrame) -> DataFrame:
    """Level A/B rows: ``gene, drug, level, rsids``."""
    level = E.norm_level(F.col("level"))
    return cpic.filter(level.isNotNull()).select(
        T.strip(F.col("gene")).alias("gene"), T.strip(F.col("drug")).alias("drug"),
        level.alias("level"), E.defining_rsids(F.col("defining_rsids")).alias("rsids"),
    )


def cpic_rsids(cpic_ab: DataFrame) -> DataFrame:
    """Distinct ``rsid, gene`` pairs."""
    return unnest(cpic_ab, ["gene"], F.col("rsids"), "rsid").select("rsid", "gene").distinct()


def cpic_gene_members(cpic_ab: DataFrame) -> DataFrame:
    """Per gene the distinct levels, drugs and rsIDs as ``gene, kind, value`` rows."""
    one = F.array(F.struct(F.lit("level").alias("kind"), F.col("level").alias("value")),
                  F.struct(F.lit("drug").alias("kind"), F.col("drug").alias("value")))
    rs = F.transform("rsids", lambda r: F.struct(F.lit("rsid").alias("kind"), r.alias("value")))
    return cpic_ab.select("gene", F.inline(F.concat(one, rs))).distinct()


def level_a_alerts(cpic: DataFrame) -> DataFrame:
    return cpic.filter(E.norm_level(F.col("level")) == "A")


def candidate_universe(clinvar_ref: DataFrame, cpic_pairs: DataFrame) -> DataFrame:
    return clinvar_ref.select("rsid").unionByName(cpic_pairs.select("rsid")).distinct()


def found_calls(calls: DataFrame, universe: DataFrame, keys=("sample_id", "rsid")) -> DataFrame:
    """Last call per key for ids of the universe, no-calls left out."""
    keys = list(keys)
    wanted = prefilter(calls, universe, "rsid").select(*keys, "chrom", "pos", "genotype", "line_no")
    last = last_wins(wanted, keys)
    return last.filter(G.genotype_found(F.col("genotype")) == "y")


def clinvar_match(found: DataFrame, clinvar_ref: DataFrame) -> DataFrame:
    """Pass A: called sites whose genotype is not known to lack the pathogenic allele, with the
    strand it matched on. An allele that is no single base stays in with a null match. Rows
    whose gene is on the secondary-findings list are flagged (pass B)."""
    ref = clinvar_ref.select("rsid", "pathogenic_allele", "gene", "vcv", "significance")
    m = G.allele_match(F.col("genotype"), F.col("pathogenic_allele"))
    return (
        found.join(ref, "rsid")
        .withColumn("_m", m)
        .withColumns({"allele_matched": F.col("_m.matched"), "strand": F.col("_m.strand")})
        .drop("_m")
        .filter(F.coalesce("allele_matched", F.lit(True)))
    )


def acmg_flag(matches: DataFrame, genes=K.ACMG_GENES) -> DataFrame:
    return matches.withColumn("acmg", F.col("gene").isin(*genes))


def cpic_match(found: DataFrame, cpic_pairs: DataFrame) -> DataFrame:
    """Pass C: called sites that define a level A/B gene."""
    return found.join(cpic_pairs.select("rsid", F.col("gene").alias("cpic_gene")), "rsid")


def cpic_evidence(found: DataFrame, cpic_ab: DataFrame) -> DataFrame:
    """The level A/B rows behind pass C, one for each call, gene, level and drug, with the source and
    identifier that a ledger cites them by."""
    rows = unnest(cpic_ab, ["gene", "drug", "level"], F.col("rsids"), "rsid").distinct()
    return found.join(rows, "rsid").withColumns({"source_key": F.lit("cpic"), "identifier": F.col("gene")})


def pass_union(a: DataFrame, c: DataFrame, keys=("sample_id", "rsid")) -> DataFrame:
    """One row per key with the passes it met (``A``, ``B``, ``C`` in order). The call columns
    are the same on every row of a key."""
    carried = [*keys, "chrom", "pos", "genotype"]
    rows = a.select(*carried, F.lit(True).alias("_a"), F.col("acmg").alias("_b"), F.lit(False).alias("_c")) \
        .unionByName(c.select(*carried, F.lit(False).alias("_a"), F.lit(False).alias("_b"), F.lit(True).alias("_c")))
    met = rows.groupBy(*carried).agg(*[F.max(x).alias(x) for x in ("_a", "_b", "_c")])
    label = F.concat_ws(",", *[F.when(F.col(x), F.lit(n)) for x, n in (("_a", "A"), ("_b", "B"), ("_c", "C"))])
    return met.select(*carried, label.alias("passes"))


def drop_known(rows: DataFrame, index: DataFrame) -> DataFrame:
    return rows.join(index.select("rsid"), "rsid", "left_anti")


def net_new(rows: DataFrame, reference_docs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Adds ``observed`` (occurrences between word borders in the reference documents) and ``net_new``.
    Ids of the usual shape are read off the texts by one pattern; any others are looked for as they are. ``ids`` is
    a superset of the rows' ids where one is cheaper to read than the rows themselves."""
    others = (rows if ids is None else ids).select("rsid").filter(~F.col("rsid").rlike("^rs[0-9]+$"))
    counts = corpus.token_counts(reference_docs).unionByName(corpus.literal_counts(reference_docs, others))
    j = rows.join(counts, "rsid", "left")
    observed = F.coalesce("occurrences", F.lit(0).cast("bigint"))
    return j.withColumns({"observed": observed, "net_new": observed == 0}).drop("occurrences")


def citation_sources(spark) -> DataFrame:
    """The citation allow-list (eight fixed rows)."""
    return fixed_rows(
        spark, K.CITATION_SOURCES, "source_key string, url_template string, url_root string, ext string"
    )


def citation_gate(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``reason``: null when the source is listed and the URL is under its root."""
    s = sources.select("source_key", "url_root")
    j = citations.join(s, "source_key", "left")
    reason = F.when(F.col("url_root").isNull(), F.lit("source not listed")).when(
        ~F.col("url").startswith(F.col("url_root")), F.lit("url outside source root")
    )
    return j.withColumn("reason", reason).drop("url_root")


def citation_ledger_join(citations: DataFrame, ledger: DataFrame) -> DataFrame:
    """Citations ``(source_key, identifier, snapshot_date)`` with the ledger's ``url`` and
    ``url_verified``; ``in_ledger`` is false where the snapshot holds no such entry."""
    keyed = citations.withColumn("_id", E.ledger_id(F.col("identifier")))
    led = ledger.select(
        "source_key", "snapshot_date", E.ledger_id(F.col("identifier")).alias("_id"),
        "url", "url_verified", F.lit(True).alias("_hit"),
    )
    return keyed.join(led, ["source_key", "snapshot_date", "_id"], "left").withColumn(
        "in_ledger", F.coalesce("_hit", F.lit(False))
    ).drop("_id", "_hit")


# --- consistency -----------------------------------------------------------

def rsid_traceability(docs: DataFrame, index: DataFrame, key: str = "doc") -> DataFrame:
    """Per document and rsID on its live lines: ``absent`` (fails) or ``gap`` (noted only)."""
    live = corpus.live_lines(docs, key)
    cited = unnest(live, [key], T.extract_rsids(F.col("line")), "rsid").distinct()
    truth = index.select("rsid", F.col("found").alias("_found"))
    j = cited.join(truth, "rsid", "left")
    status = F.when(F.col("_found").isNull(), F.lit("absent")).when(
        F.col("_found") != "y", F.lit("gap")
    )
    return j.withColumn("status", status).filter(F.col("status").isNotNull()).select(key, "rsid", "status")


def cited_triples(docs: DataFrame, index: DataFrame, key: str = "doc") -> DataFrame:
    """Backticked genotype citations that meet an INDEX row."""
    cited = unnest(docs, [key], T.genotype_triples(F.col("text")), "_t").select(
        key, "_t.rsid", F.col("_t.genotype").alias("cited")
    )
    return cited.join(index.select("rsid", "genotype"), "rsid")


def genotype_consistency(docs: DataFrame, index: DataFrame, key: str = "doc") -> DataFrame:
    """Citations whose genotype differs from the INDEX, compared as written."""
    return cited_triples(docs, index, key).filter(F.col("cited") != F.col("genotype"))


def source_drift(docs: DataFrame, live_hash: str, key: str = "doc") -> DataFrame:
    """Per document: ``ok``, ``drift`` or ``undeclared`` against the live source hash."""
    declared = corpus.declared_hash(F.col("text"))
    both = T.let(declared, lambda h: F.struct(
        h.alias("declared"), corpus.hash_status(h, live_hash).alias("status")))
    return docs.select(key, both.alias("_d")).select(key, "_d.declared", "_d.status")


def panel_checklist(panel: DataFrame, index: DataFrame) -> DataFrame:
    """Panel ``(gene, rsid)`` rows with the INDEX state; an id outside it is named as such."""
    return panel.join(index.select("rsid", "found"), "rsid", "left").select(
        "gene", "rsid", F.coalesce("found", F.lit("? (absent from INDEX)")).alias("found")
    )


def fixed_panel(spark, pairs=K.METHYLATION_PANEL) -> DataFrame:
    return fixed_rows(spark, pairs, "gene string, rsid string")


def probe_consistency(probes: DataFrame, index: DataFrame) -> DataFrame:
    """Probe lookups whose genotype is not the INDEX genotype."""
    truth = index.select("rsid", F.col("genotype").alias("index_genotype"))
    return probes.join(truth, "rsid").filter(F.col("genotype") != F.col("index_genotype"))


def panel_gene_coverage(cpic_pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Per gene: ``covered`` when at least one defining rsID is called, else a coverage gap."""
    called = found.select("rsid").distinct().withColumn("_c", F.lit(True))
    j = cpic_pairs.join(called, "rsid", "left")
    return j.groupBy("gene").agg(
        F.count(F.lit(1)).alias("n_rsids"), F.count("_c").alias("n_called")
    ).withColumn("covered", F.col("n_called") > 0)


def cross_reference_check(docs: DataFrame, key: str = "doc") -> DataFrame:
    """Markdown links that break the cross-reference form: ``key, target, reason``. A link is
    fine when it is ``./file#anchor``, the file exists and one of its headings has that slug."""
    link = r"\[[^\]]*\]\(([^)\s]+)\)"
    links = unnest(docs, [key], F.regexp_extract_all("text", F.lit(link), F.lit(1)), "target")
    links = links.withColumns({
        "_file": F.when(F.col("target").startswith("./"),
                        F.substring_index(F.substr("target", F.lit(3)), "#", 1)),
        "_slug": F.when(F.col("target").contains("#"), F.substring_index("target", "#", -1)),
    })
    names = docs.select(F.col(key).alias("_file"), F.lit(True).alias("_has_file"))
    heads = corpus.doc_lines(docs, key).filter(F.col("line").rlike(T.HEADING)).select(
        F.col(key).alias("_file"),
        T.slug(F.regexp_replace("line", r"^\s*#+", "")).alias("_slug"), F.lit(True).alias("_has_slug"),
    ).distinct()
    j = links.join(names, "_file", "left").join(heads, ["_file", "_slug"], "left")
    reason = (
        F.when(F.col("target").rlike("^[a-z]+://"), F.lit(None))
        .when(F.col("_file").isNull(), F.lit("not a relative link"))
        .when(F.col("_file").contains("archive/"), F.lit("points into the archive"))
        .when(F.col("_has_file").isNull(), F.lit("file not found"))
        .when(F.col("_slug").isNotNull() & F.col("_has_slug").isNull(), F.lit("anchor not found"))
    )
    return j.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(key, "target", "reason")
