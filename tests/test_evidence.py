from pyspark.sql import functions as F

from locusgrid.functions import evidence as X
from locusgrid.functions import genotype as G
from locusgrid.functions import sequence as S
from locusgrid.functions import variant as V
from locusgrid.operators import evidence as E
from locusgrid.operators import gates
from locusgrid.plans import jobs


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_genotype_functions(spark):
    df = spark.createDataFrame([("A/G",), ("GA",), (" T|C",), ("--",), ("00",), ("not_tested",), ("A",), ("ID",), ("0 0",)], "g string")
    g = F.col("g")
    got = [tuple(r) for r in df.select(
        G.norm_genotype(g), G.is_no_call(g, "summary"), G.genotype_found(g), G.is_no_call(g, "vcf"), G.split_alleles(g)).collect()]
    assert got[0] == ("AG", False, "y", False, ["A", "G"])
    assert got[1][0] == "AG" and got[2][0] == "CT"
    assert got[3] == ("--", True, "n", True, [])
    assert got[4] == ("00", True, "y", True, [])
    assert got[5][1:4] == (False, "n", False)
    assert got[6][4] == ["A"] and got[7][4] == ["I", "D"] and got[8][1] is True


def test_allele_match(spark):
    df = spark.createDataFrame([("AG", "a"), ("AG", "T"), ("AA", "C"), ("AG", "AT"), ("AG", "")], "g string, a string")
    got = [tuple(r.m) for r in df.select(G.allele_match(F.col("g"), F.col("a")).alias("m")).collect()]
    assert got == [(True, "direct"), (True, "complement"), (False, "none"), (None, "unmatched"), (None, "unmatched")]


def test_sequence_functions(spark):
    s = F.lit("ATGgcuTAAnnx")
    r = one(spark, S.translate(s), S.translate_frame(s, 2), S.translate(F.lit("AT")), S.reverse_complement(F.lit("ACGTUNacgtunX")),
            S.gc_percent(F.lit("")), S.ambiguous_bases(F.lit("ACGTUNx")), S.wrap_fixed(F.lit("ABCDEF"), 3), S.wrap_fixed(F.lit("ABCDEFG"), 3),
            S.aligned_length(F.lit("5S10M2I3D4H")), S.reference_span(F.lit("5S10M2I3D4N")), S.translate(F.lit("ATAAGATGA"), "5"))
    assert tuple(r) == ("MA*X", "WLX", "", "XnaacgtNAACGT", 0.0, 2, "ABC\nDEF", "ABC\nDEF\nG", 12, 17, "MSW")


def test_variant_functions(spark):
    rows = [("A", "G", None), ("A", ".", None), ("AC", "GT", None), ("A", "ATG,G", None), ("A", "*", None), ("A", "T", "DEL"), ("ACGT", "A", None), ("A", "A", None)]
    df = spark.createDataFrame(rows, "ref string, alt string, sv string")
    r, a, s = F.col("ref"), F.col("alt"), F.col("sv")
    got = [tuple(x) for x in df.select(V.variant_class(r, a, s), V.report_class(r, a, s), V.is_frameshift(r, a), V.is_transition(r, a)).collect()]
    assert [g[0] for g in got] == ["snv", "other", "mnp", "indel", "indel", "sv", "indel", "snv"]
    assert [g[1] for g in got] == ["snv", "indel", "mnp", "indel", "snv", "sv", "indel", "snv"]
    # A -> ATG adds two bases, ACGT -> A removes three.
    assert [g[2] for g in got] == [False, False, False, True, False, False, False, False]
    assert got[0][3] and not got[7][3]


def test_evidence_functions(spark):
    r = one(spark, X.norm_level(F.lit(" level a ")), X.norm_level(F.lit("C")), X.is_pathogenic(F.lit(" Likely Pathogenic ")),
            X.citation_url(F.lit("u/{id_numeric}/{id}"), F.lit("VCV0012")), X.ledger_id(F.lit("a b/c-1.x")),
            X.feature_name(F.lit("x=1; ID=g 1 ;y")), X.feature_name(F.lit('gene_id "q"; z')), X.feature_name(F.lit("none")))
    assert tuple(r) == ("A", None, True, "u/0012/VCV0012", "a_b_c-1.x", "g 1", "q", ".")


def cohort(spark):
    calls = spark.createDataFrame([
        ("s", "rs1", "1", 1, "AG", 1), ("s", "rs2", "1", 2, "CC", 2), ("s", "rs3", "1", 3, "--", 3), ("s", "rs4", "2", 4, "TT", 4),
        ("s", "rs5", "2", 5, "GG", 5), ("s", "rs6", "2", 6, "AG", 6)],
        "sample_id string, rsid string, chrom string, pos bigint, genotype string, line_no bigint")
    cv = spark.createDataFrame([
        ("rs1", "A", "BRCA1", "VCV1", "Pathogenic"), ("rs2", "A", "X", "VCV2", "pathogenic"), ("rs3", "A", "X", "VCV3", "Pathogenic"),
        ("rs4", "A", "X", "VCV4", "Likely pathogenic"), ("rs5", "GT", "X", "VCV5", "Pathogenic"), ("rs6", "A", "X", "VCV6", "Benign")],
        "rsid string, pathogenic_allele string, gene string, vcv string, significance string")
    cpic = spark.createDataFrame([("G1", "d1", "Level B", "rs2;rs3, rs1"), ("G1", "d2", "A", "rs2"), ("G2", "d3", "C", "rs6")],
                                 "gene string, drug string, level string, defining_rsids string")
    return calls, cv, cpic


def test_discover(spark):
    calls, cv, cpic = cohort(spark)
    known = spark.createDataFrame([("rs4",)], "rsid string")
    ref = spark.createDataFrame([("f.md", "rs1 seen, rs1 again, rs22")], "doc string, text string")
    ledger = spark.createDataFrame([("clinvar", "VCV1", "2026-01-15", "u1", True)], "source_key string, identifier string, d string, url string, url_verified boolean") \
        .withColumn("snapshot_date", F.col("d").cast("date")).drop("d")
    out = jobs.discover_candidates(calls, known, cv, cpic, ref, ledger, "2026-01-15")
    got = {r.rsid: (r.passes, r.net_new, r.observed) for r in out["candidates"].collect()}
    assert got == {"rs1": ("A,B,C", False, 2), "rs2": ("C", True, 0), "rs5": ("A", True, 0)}
    assert out["summary"].first()[0:3] == (3, 2, 1)
    ev = {r.vcv: (r.allele_matched, r.strand, r.in_ledger, r.url_verified) for r in out["clinvar"].collect()}
    assert ev == {"VCV1": (True, "direct", True, True), "VCV5": (None, "unmatched", False, None)}
    members = sorted(tuple(r) for r in out["cpic_members"].collect())
    assert ("G1", "level", "A") in members and ("G1", "level", "B") in members and len(members) == 7
    ext = E.extend_index(
        spark.createDataFrame([("rs4", "2", "4", "TT", "y", None)], "rsid string, chromosome string, position string, genotype string, found string, discovered_in_phase int"),
        out["candidates"].select("rsid", F.col("chrom").alias("chromosome"), F.col("pos").cast("string").alias("position"), "genotype"))
    assert sorted((r.rsid, r.discovered_in_phase) for r in ext.collect()) == [("rs1", 6), ("rs2", 6), ("rs4", 0), ("rs5", 6)]


def test_complement_strand_is_kept(spark):
    calls, cv, _ = cohort(spark)
    none = spark.createDataFrame([], "rsid string")
    ref = spark.createDataFrame([("f.md", "x")], "doc string, text string")
    out = jobs.discover_candidates(calls, none, cv, None, ref)
    assert {r.vcv: r.strand for r in out["clinvar"].collect()}["VCV4"] == "complement"


def test_panels(spark):
    idx = spark.createDataFrame([("rs1801133", "y"), ("rs234706", "n")], "rsid string, found string")
    got = {r.rsid: r.found for r in E.panel_checklist(E.fixed_panel(spark), idx).collect()}
    assert len(got) == 11 and got["rs1801133"] == "y" and got["rs234706"] == "n" and got["rs502396"] == "? (absent from INDEX)"
    calls, _, cpic = cohort(spark)
    pairs = E.cpic_rsids(E.cpic_reference(cpic))
    cov = E.panel_gene_coverage(pairs, E.found_calls(calls, pairs)).collect()
    assert [(r.gene, r.n_rsids, r.n_called, r.covered) for r in cov] == [("G1", 3, 2, True)]


def test_gates(spark):
    cits = spark.createDataFrame([("pubmed", "https://pubmed.ncbi.nlm.nih.gov/1/"), ("pubmed", "http://x"), ("blog", "http://x")], "source_key string, url string")
    got = [r.reason for r in E.citation_gate(cits, E.citation_sources(spark)).orderBy(F.desc("source_key"), "url").collect()]
    assert got == ["url outside source root", None, "source not listed"]
    f = spark.createDataFrame([("G", "n", "A", "x", 1, [("rs1",)], [("c",)]), ("G", "", "A", "x", 7, [], None), ("G", "n", "A", "x", 2, [(None,)], [("c",)])],
                              "gene string, name string, evidence string, implication string, tier int, triples array<struct<rsid:string>>, citations array<struct<k:string>>")
    ok, bad = gates.split_accepted(gates.finding_gate(f))
    assert ok.count() == 1
    assert sorted(r.reasons for r in bad.collect()) == [["missing name", "tier not 1-3", "no triple", "no citation"], ["triple without rsid"]]
    c = spark.createDataFrame([(None, "rs1", ["k"]), (True, None, []), (False, None, None)], "clinical boolean, rsid string, citation_keys array<string>")
    assert [len(r.reasons) for r in gates.claim_gate(c).collect()] == [0, 2, 0]
    d = spark.createDataFrame([("a", "fine"), ("b", "may")], "doc string, text string")
    kept, found = gates.phrase_gate(d)
    assert [r.doc for r in kept.collect()] == ["a"] and found.count() == 1
    g = spark.createDataFrame([("g1",), ("g2",)], "group string")
    m = spark.createDataFrame([("g1",), ("g1",), ("g3",)], "group string")
    assert sorted(tuple(r) for r in gates.docs_per_group(m, g).collect()) == [("g1", 2), ("g2", 0)]


def test_audit_totals_read_the_claims_once(spark):
    kind = "doc long, rsids array<string>, stated_genotype string"
    claims = spark.createDataFrame([(1, ["rs1"], "AG"), (2, ["rs1"], "GG"), (3, ["rs2", "rs1"], "AA"), (4, ["rs2"], None), (5, [], "CC"),
                                    (6, [], "CT"), (7, None, None), (8, ["rs3"], "AA"), (9, ["rs3"], "AA")], kind)
    docs = spark.range(12)
    one, two = E.audit_totals(docs, claims), E.audit_totals(docs, claims, E.contradictions(claims))
    assert one.columns == two.columns and one.collect() == two.collect() and tuple(one.first()) == (12, 9, 1)
    reads = one._jdf.queryExecution().optimizedPlan().toString().count("rsids#")
    assert 0 < reads < two._jdf.queryExecution().optimizedPlan().toString().count("rsids#")
    assert tuple(E.audit_totals(docs, claims.limit(0)).first()) == (12, 0, 0)
