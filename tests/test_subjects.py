"""Ids of any shape, overlaps by endpoints and verification by subject, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from locusgrid.operators import corpus as C
from locusgrid.operators import evidence as E
from locusgrid.operators import intervals as I
from locusgrid.plans import jobs

IDS = ["rs12", "i3001", "exm-rs12", "7:12:A:G", "-x", "x-", "--", "a b", "naïve", "é", "rs1", "z" * 40, "a\nb", "x"]


def brute(texts, ids):
    out = {}
    for i in set(ids):
        # Every place is tried, so occurrences may share characters.
        n = sum(len(re.findall(rf"(?=\b{re.escape(i)}\b)", t)) for t in texts if t)
        if n and i:
            out[i] = n
    return out


def test_literal_counts_against_brute_force(spark):
    rng = random.Random(4)
    pieces = [*IDS, " ", "-", ",", ".", "\n", "_", "rs", "1", "", ":", "A"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))) for _ in range(150)]
    texts += [None, "", "x", "--", "-x", "x-", "a--b", "rs12", " rs12", "exm-rs12-exm-rs12", "x " * 20000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    ids = spark.createDataFrame([(i,) for i in [*IDS, "rs12", None, ""]], "rsid string")
    want = brute(texts, IDS)
    for limit in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = {r.rsid: r.occurrences for r in C.literal_counts(docs, ids).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got == want
    assert len(want) > 10
    assert C.literal_counts(docs, ids.limit(0)).collect() == []
    assert C.literal_counts(docs.limit(0), ids).collect() == []


def test_literal_counts_spell_only_runs_that_can_begin_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([("x-1 exm-rs12 y exm-rs1 e-f " * 20,)], "text string")
    made = []

    def seen(found, keys, on):
        made.append(found.count())
        return found

    monkeypatch.setattr(C, "prefilter", seen)
    got = C.literal_counts(docs, spark.createDataFrame([("exm-rs12",), ("é",)], "rsid string")).collect()
    assert [tuple(r) for r in got] == [("exm-rs12", 20)]
    assert made == [3 * 20]  # exm-rs12, exm-rs1 and e-f, not every three runs


def test_net_new_counts_other_shapes(spark):
    docs = spark.createDataFrame([("seen exm-rs12 and i3001, rs12.",), ("i3001",)], "text string")
    rows = spark.createDataFrame([("i3001",), ("exm-rs12",), ("rs12",), ("kgp5",), (None,)], "rsid string")
    got = {r.rsid: (r.observed, r.net_new) for r in E.net_new(rows, docs).collect()}
    assert got == {"i3001": (2, False), "exm-rs12": (1, False), "rs12": (2, False), "kgp5": (0, True), None: (0, True)}


def test_overlap_join_of_any_lengths(spark):
    rng = random.Random(9)

    def spans(n):
        rows = [("c", a, a + rng.choice([0, 1, 2, 50, 1 << 14, 1 << 21, 1 << 27])) for a in (
            rng.randrange(0, 1 << rng.choice([4, 15, 22, 28])) for _ in range(n))]
        return [*rows, ("c", 0, 250_000_000), ("c", 5, None), ("d", 1, 2), (None, 1, 2)] + [("c", 1 << 14, (1 << 14) + 1)] * 3

    left = [(i, *r) for i, r in enumerate(spans(120))]
    right = [(i, *r) for i, r in enumerate(spans(120))]
    ldf = spark.createDataFrame(left, "l long, chrom string, a long, b long")
    rdf = spark.createDataFrame(right, "r long, chrom string, start0 long, end0 long")
    got = sorted((x.l, x.r) for x in I.overlap_join(ldf, rdf, left_span=("a", "b")).select("l", "r").collect())
    want = sorted((i, j) for i, c, a, b in left for j, d, s, e in right
                  if c and c == d and None not in (b, e) and a < b and s < e and a < e and s < b)
    assert got == want


def test_a_long_interval_is_a_bounded_number_of_rows(spark):
    row = spark.createDataFrame([("c", 0, 250_000_000)], "chrom string, s long, e long")
    bins = I._bins(F.col("s") + 1, F.col("e"), I.BIN_WIDTHS)
    assert I._filed_and_looked(row, bins, 1, I._lookups(F.col("s"), I.BIN_WIDTHS)).count() <= I.MAX_BINS + 3


def test_verification_by_subject(spark):
    text = "---\nsource_genome_sha256: {}\n---\n## Provenance Summary\nrs1 and rs2 `rs1 1:10 {}`\n"
    docs = spark.createDataFrame(
        [(1, "a", text.format("AB", "AG")), (1, "b", text.format("CD", "AA")), (2, "a", text.format("CD", "AG")),
         (None, "a", text.format("AB", "AG")), (3, "c", None)], "sample_id long, doc string, text string")
    index = spark.createDataFrame(
        [(1, "rs1", "y", "AG"), (1, "rs2", "n", "--"), (2, "rs1", "y", "GG")], "sample_id long, rsid string, found string, genotype string")
    live = spark.createDataFrame([(1, "ab")], "sample_id long, live_hash string")
    prompts = spark.createDataFrame([(2, "other.md")], "sample_id long, name string")
    files = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p")], "sample_id long, path string")
    expected = spark.createDataFrame([(1, 2), (2, 3)], "sample_id long, expected long")
    got = {(r.sample_id, r["check"]): (r.status, r.n_fail, r.n_note) for r in jobs.verify_corpus_by_sample(
        docs, index, live, prompts, files, expected).collect()}
    assert len(got) == 4 * len(jobs.CHECKS)
    assert got[1, "genome_sha"] == ("fail", 1, 0) and got[2, "genome_sha"] == ("skip", 0, 0)
    assert got[1, "genotype_consistency"] == ("fail", 1, 0)  # the text of document b says AA
    assert got[2, "genotype_consistency"] == ("fail", 1, 0) and got[None, "genotype_consistency"][0] == "pass"
    assert got[1, "rsid_traceability"] == ("pass", 0, 2)  # rs2 is a gap in both documents
    assert got[2, "rsid_traceability"] == ("fail", 1, 0) and got[None, "rsid_traceability"] == ("fail", 2, 0)
    assert got[1, "archive_integrity"] == ("pass", 0, 0) and got[2, "archive_integrity"] == ("fail", 1, 0)
    assert got[None, "continuation_prompts"][0] == "fail"
    # Each subject alone gives what the form for one subject gives.
    one = {r["check"]: (r.status, r.n_fail, r.n_note) for r in jobs.verify_corpus(
        docs.filter("sample_id = 1").drop("sample_id"), index.filter("sample_id = 1"), "ab").collect()}
    for check in ("genome_sha", "rsid_traceability", "genotype_consistency", "provenance_coverage"):
        assert one[check] == got[1, check]
