import pytest
from pyspark.sql import functions as F

from locusgrid.functions import text as T
from locusgrid.operators import corpus as C
from locusgrid.operators import evidence as E
from locusgrid.plans import jobs


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}.md", t) for i, t in enumerate(texts)], "doc string, text string")


def hits(spark, text):
    return [(r.lineno, r.token) for r in C.phrase_hits(docs(spark, text)).orderBy("lineno", "token").collect()]


@pytest.mark.parametrize("text, want", [
    ("# Quotes\n> [verbatim from archive: old.md]\n> Sleep might shift, and it could settle\n> best at night.\n", []),
    ("> Coffee could matter here.\n> [verbatim from archive: notes.md]\n", []),
    ("* \"could taste bitter\" [verbatim from archive: taste.md] taken out\n", []),
    ("You should consider what might follow.\n", [(1, "might"), (1, "should consider")]),
    ("> [verbatim from archive: x.md]\n> quoted, it might\n\nUnquoted, it could.\n", [(4, "could")]),
    ("> no archive mark, so it could count\n", [(1, "could")]),
    ("The word `could` is only named.\n", []),
    ("```\nmay might could\n```\nmight\n", [(4, "might")]),
    ("```\n## Appendix\n```\nit may\n", []),
    ("# Glossary\nmay\n# Body\nMAY Likely\n", [(4, "Likely"), (4, "MAY")]),
    ("likely-pathogenic per ClinVar VCV1\n", []),
    ("likely-pathogenic per nothing\n", [(1, "likely")]),
    ("Carriers are likely-benign\n", []),
    ("likely normal VCV1, e.g. others etc.\n", [(1, "e.g."), (1, "etc."), (1, "likely"), (1, "others")]),
    ("émay and mayé, maybe\r\nbest\x0bBeſt\n", [(2, "best"), (3, "Beſt")]),
    ("", []),
    ("```\nopen may\nstill may", []),
])
def test_phrase_hits(spark, text, want):
    assert hits(spark, text) == want


def test_custom_phrases(spark):
    got = C.phrase_hits(docs(spark, "colour color\nnone"), [r"\bcolou?r\b"]).orderBy("token").collect()
    assert [r.token for r in got] == ["color", "colour"]
    cited = "most likely-benign and likely-benign per ClinVar VCV1"
    assert [r.token for r in C.phrase_hits(docs(spark, cited), [r"\bmost likely\b", r"\blikely\b"]).collect()] == ["most likely"]


def test_rows_without_significance_are_skipped_rows(spark):
    ref = spark.createDataFrame([("Pathogenic",), ("benign",), (None,)], "significance string")
    assert E.clinvar_skipped(ref).first().skipped == 2


def test_audit_by_sample(spark):
    d = spark.createDataFrame([(1, "a", "At rs0000001 AG the enzyme works, PMID 1."), (2, "a", "At rs0000001 AG the enzyme works, PMID 1."),
                               (3, "b", "rs0000001 x")], "sample_id bigint, doc string, text string")
    calls = spark.createDataFrame([(1, "rs0000001", "1", 5, "AG", 1), (2, "rs0000001", "1", 5, "GG", 1), (2, "rs0000001", "1", 5, "CC", 0)],
                                  "sample_id bigint, rsid string, chrom string, pos bigint, genotype string, line_no bigint")
    got = {(r.sample_id, r.doc): (r.disposition, r.genotype_mismatch) for r in jobs.audit_claims_by_sample(d, calls).collect()}
    assert got == {(1, "a"): ("keep", False), (2, "a"): ("keep", True), (3, "b"): ("delete", None)}


def test_lines_follow_every_break(spark):
    got = C.doc_lines(docs(spark, "a\r\nb\rc\n\nd e\n", "", "\n")).orderBy("doc", "lineno").collect()
    assert [(r.doc, r.lineno, r.line) for r in got] == [
        ("d0.md", 1, "a"), ("d0.md", 2, "b"), ("d0.md", 3, "c"), ("d0.md", 4, ""), ("d0.md", 5, "d"), ("d0.md", 6, "e"), ("d2.md", 1, "")]


def test_state_matches_a_plain_loop(spark):
    import random

    rng = random.Random(7)
    pieces = ["```", "text", "> q", "> [verbatim from archive: x]", "# Appendix", "## Body", "#", "", "  ```py", "---", " > q2"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    got = {}
    for r in C.line_states(docs(spark, *texts), list(C.LINE_FLAGS)).collect():
        got[r.doc, r.lineno] = (r.fenced, r.code, r.front_matter, r.exempt_section, r.archive_quote, r.heading)
    for d, text in enumerate(texts):
        lines = text.split("\n")
        if lines and lines[-1] == "":
            lines.pop()
        fm = -1
        if lines and lines[0].strip() == "---":
            fm = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), len(lines) - 1)
        fence = code = False
        heading = ""
        for i, ln in enumerate(lines):
            mark = ln.strip().startswith("```")
            if ln.lstrip().startswith("#") and ln.lstrip().lstrip("#").strip():
                heading = ln.lstrip("#").strip()
            a = b = i
            quoted = ln.lstrip().startswith(">")
            while quoted and a > 0 and lines[a - 1].lstrip().startswith(">"):
                a -= 1
            while quoted and b + 1 < len(lines) and lines[b + 1].lstrip().startswith(">"):
                b += 1
            archive = quoted and any("[verbatim from archive" in x for x in lines[a:b + 1])
            in_code = i > fm and (mark or code)
            low = heading.lower()
            want = (mark or fence, in_code, i <= fm, "glossary" in low or "appendix" in low, archive, heading)
            assert got[f"d{d}.md", i + 1] == want, (text, i)
            if mark:
                fence = not fence
                code = not code if i > fm else code
        assert (f"d{d}.md", len(lines) + 1) not in got


def test_front_matter(spark):
    d = docs(spark, "---\na: 1\nb:x: y\na: 2\n no colon\n---\nc: 3", "a: 1", "---\nk: v", "---\n---\n")
    got = {r.doc: r.front_matter for r in C.front_matter_map(d).collect()}
    assert got == {"d0.md": {"a": "2", "b": "x: y"}, "d1.md": {}, "d2.md": {"k": "v"}, "d3.md": {}}


def test_pool_sections_context(spark):
    d = docs(spark, "MTHFR cites rs1 and rs2.\n", "Again rs2; also rs3 (xrs4, rs5x).\n## Timeline 1\n t1 \n\n## Plan\np\n")
    pool = [r.rsid for r in C.first_seen_pool(d).orderBy("first_doc", "first_pos").collect()]
    assert pool == ["rs1", "rs2", "rs3"]
    pairs = sorted((r.rsid, r.doc) for r in C.citing_docs(d).collect())
    assert pairs == [("rs1", "d0.md"), ("rs2", "d0.md"), ("rs2", "d1.md"), ("rs3", "d1.md")]
    s = [(r.heading, r.body) for r in C.sections(d).orderBy("doc", "section_no").collect()]
    assert s == [("Timeline 1", "t1"), ("Plan", "p")]
    assert [r.timeline for r in C.project_context(d).orderBy("doc").collect()] == ["", "t1"]


def test_truth_index_rows(spark):
    d = docs(spark, "rs0000001 and rs0000002.\n", "rs0000002; rs0000003\n")
    calls = spark.createDataFrame(
        [("p", "rs0000001", "1", 11111, "GG", 1), ("p", "rs0000001", "1", 11111, "AG", 5), ("p", "rs0000002", "2", 22222, "--", 2)],
        "path string, rsid string, chrom string, pos bigint, genotype string, line_no bigint")
    out = jobs.build_truth_index(d, calls)
    got = [tuple(r) for r in out["index"].orderBy("first_doc", "first_pos").select("rsid", "chromosome", "position", "genotype", "found").collect()]
    assert got == [("rs0000001", "1", "11111", "AG", "y"), ("rs0000002", "2", "22222", "--", "n"), ("rs0000003", "", "", "not_tested", "n")]
    assert out["coverage"].first()[0:3] == (3, 1, 2)
    assert sorted(tuple(r) for r in out["gaps"].select("rsid", "doc").collect()) == [("rs0000002", "d0.md"), ("rs0000002", "d1.md"), ("rs0000003", "d1.md")]
    for fmt, asm, why in (("bed", "GRCh37", "not a consumer export"), ("consumer_dna:23andme", None, "no assembly")):
        files = spark.createDataFrame([("p", fmt, asm)], "path string, format string, assembly string")
        with pytest.raises(Exception, match=why):
            jobs.build_truth_index(d, calls, files)["index"].collect()


def index(spark):
    return spark.createDataFrame([("rs0000001", "AG", "y"), ("rs0000002", "--", "n")], "rsid string, genotype string, found string")


def test_audit_corpus(spark):
    d = docs(
        spark, "# Liver\nCYP2C9 rs0000001 AG lowers the metabolizer phenotype, PMID 123456.\n",
        "# Stomach\nAt rs0000001 AG the enzyme works slowly.\n",
        "# Open points\nThis genotype could change folate.\nDeficiency at rs0000002 runs in the family.\nA carrier of rs0000009 has the risk allele.\n")
    out = jobs.audit_claims(d, index(spark), project_terms=["phenotype", "Liver"])
    assert {r.disposition: r.n_claims for r in out["summary"].collect() if r.n_claims} == {
        "delete": 3, "rewrite-with-citation": 1, "keep": 1}
    c = {r.text: r for r in out["claims"].collect()}
    keep = c["CYP2C9 rs0000001 AG lowers the metabolizer phenotype, PMID 123456."]
    assert (keep.disposition, keep.supporting, keep.has_citation, keep.genotype_mismatch, keep.project_terms) == ("keep", ["rs0000001"], True, False, ["phenotype"])
    gone = c["A carrier of rs0000009 has the risk allele."]
    assert (gone.absent, gone.supporting, gone.missing_rsid_linkage) == (["rs0000009"], [], True)


def test_mismatch_and_contradictions(spark):
    d = docs(spark, "rs0000001 G/A seen\n", "rs0000001 GG seen\nrs0000001 AG and CC\nrs0000002 AA x\n---|---\n---\n")
    lines = C.claim_lines(d)
    c = E.claim_support(lines, index(spark)).orderBy("doc", "lineno").collect()
    assert [(r.stated_genotype, r.genotype_mismatch) for r in c] == [("AG", False), ("GG", True), (None, None), ("AA", None)]
    got = sorted(tuple(r) for r in E.contradictions(lines).collect())
    assert got == [("rs0000001", "AG", "d0.md"), ("rs0000001", "GG", "d1.md")]


def test_genotype_tokens(spark):
    df = spark.createDataFrame([("AG xAG AGx A/G T|C -- a--b DD ID AG",)], "l string")
    assert df.select(T.genotype_tokens(F.col("l"))).first()[0] == ["AG", "A/G", "T|C", "--", "DD", "ID", "AG"]


def test_verify(spark):
    clean = "---\nsource_genome_sha256: ABCD\n---\n## Provenance Summary\nSee `rs0000001 1:1,000 AG` fine.\n"
    prompts = spark.createDataFrame([(f"phase{n}_prompt.md",) for n in range(8)], "name string")
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    good = jobs.verify_corpus(docs(spark, clean), index(spark), "abcd", prompts, files, 2)
    assert {r.check: r.status for r in good.collect()} == {c: "pass" for c in jobs.CHECKS}
    skipped = jobs.verify_corpus(docs(spark, clean))
    assert jobs.check_rollup(skipped).first()[0:3] == (3, 0, 5)
    dirty = ("---\nsource_genome_sha256: ffff\n---\nIt may benefit rs0000009 and rs0000002\n`rs0000001 1:1 GG`\n"
             "> [verbatim from archive: z] rs0000077 may benefit\n")
    bad = jobs.verify_corpus(docs(spark, dirty, clean), index(spark), "abcd", prompts.limit(7), files, 3)
    got = {r.check: (r.status, r.n_fail, r.n_note) for r in bad.collect()}
    assert got == {
        "archive_integrity": ("fail", 1, 0), "genome_sha": ("fail", 1, 0), "provenance_coverage": ("fail", 1, 0),
        "aspirational_narrow": ("fail", 1, 0), "aspirational_blacklist": ("fail", 1, 0), "rsid_traceability": ("fail", 1, 1),
        "genotype_consistency": ("fail", 1, 0), "continuation_prompts": ("fail", 1, 0)}


def test_cross_references(spark):
    d = spark.createDataFrame([
        ("a.md", "# A\n## Codeine Reclassification\n[x](./b.md#body) [y](./b.md#none) [z](./c.md#body) [w](/abs/b.md) [v](./archive/b.md) [u](https://x.org/p) [t](./a.md#codeine-reclassification)"),
        ("b.md", "## Body\n")], "doc string, text string")
    got = {r.target: r.reason for r in E.cross_reference_check(d).collect()}
    assert got == {"./b.md#none": "anchor not found", "./c.md#body": "file not found", "/abs/b.md": "not a relative link",
                   "./archive/b.md": "points into the archive"}
