import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from locusgrid.functions.text import fixed_round
from locusgrid.operators import alignments as A
from locusgrid.operators import calls as C
from locusgrid.operators import intervals as I
from locusgrid.operators import sequences as S
from locusgrid.operators import variants as V
from locusgrid.plans import jobs
from locusgrid.sources import formats as R
from locusgrid.sources import lines as L
from locusgrid.sources import sinks as W


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def calls(spark, data, name):
    return R.read_calls(spark, f"{data}/{name}")


def test_three_layouts(spark, data):
    for name, n in (("me.txt", 6), ("ancestry.txt", 4), ("heritage.csv", 2)):
        got = rows(calls(spark, data, name).select("rsid", "chrom", "pos", "genotype", "sample_id"), "rsid")
        assert len(got) == n
        assert got[0] == ("rs5012", "3", 41000, "CT", name.split(".")[0])
    assert rows(calls(spark, data, "heritage.csv").select("rsid", "genotype"), "rsid")[1] == ("rs5033", "AC")


def test_calls_summary_and_build(spark, data):
    s = C.calls_summary(calls(spark, data, "me.txt")).first()
    assert (s.snp_count, s.no_call_rate) == (6, 1 / 6)
    files = R.export_files(L.numbered_lines(spark, f"{data}/me.txt")).first()
    assert (files.vendor, files.assembly) == ("23andme", "GRCh37")


def test_unknown_file_is_refused(spark, data):
    with pytest.raises(Exception, match="not a recognized consumer DNA file"):
        R.read_calls(spark, f"{data}/s.bed").collect()


def test_short_rows_and_positions(spark, tmp_path):
    (tmp_path / "x.txt").write_text("# 23andMe build 38 build 37\nrsid\tc\tp\tg\nrs1\t1\t5\nRS2\t1\tfive\tAA\nrs2\t1\t7\tAA\n")
    p = str(tmp_path / "x.txt")
    assert rows(R.short_rows(spark, p).select("short_rows", "rows")) == [(1, 2)]
    assert [r.pos for r in R.read_calls(spark, p).orderBy("line_no").collect()] == [None, 7]
    assert R.export_files(L.numbered_lines(spark, p)).first().assembly == "GRCh38"
    acc = L.source_line_accounting(L.numbered_lines(spark, p)).first().asDict()
    assert (acc["total_lines"], acc["comment_lines"], acc["header_lines"], acc["data_rows"], acc["malformed_rows"]) == (5, 1, 1, 2, 1)


def test_vendor_by_shape(spark):
    heads = ["rsid\tchromosome\tposition\tgenotype\nrs1\t1\t1\tAA", "rsid\tchromosome\tposition\ta1\ta2\nrs1\t1\t1\tA\tA",
             "RSID,CHROMOSOME,POSITION,RESULT\nrs1,1,1,AA", "other", "visit Ancestry.com", ""]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string")
    got = [r.v for r in df.select("i", L.vendor_of(F.col("h")).alias("v")).orderBy("i").collect()]
    assert got == ["23andme", "ancestrydna", "myheritage", None, "ancestrydna", None]


def test_catalog_formats(spark, data, tmp_path):
    for n in ("s.bed", "s.fasta", "s.gff", "s.gtf", "s.sam", "s.vcf", "s.fastq", "me.txt"):
        body = open(f"{data}/{n}").read()
        (tmp_path / n).write_text(body)
        with gzip.open(tmp_path / (n + ".gz"), "wt") as fh:
            fh.write(body)
    (tmp_path / "s.fasta.fai").write_text("x")
    (tmp_path / "s.vcf.gz.tbi").write_text("x")
    (tmp_path / "c.cram").write_bytes(b"CRAM\x03\x00")
    (tmp_path / "notes.dat").write_text("hello\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in L.file_catalog(spark, str(tmp_path)).collect()}
    want = {"s.bed": "bed", "s.fasta": "fasta", "s.gff": "gff", "s.gtf": "gtf", "s.sam": "sam", "s.vcf": "vcf", "s.fastq": "fastq",
            "me.txt": "consumer_dna:23andme"}
    for n, fmt in want.items():
        assert (got[n].format, got[n].compressed) == (fmt, False)
        assert (got[n + ".gz"].format, got[n + ".gz"].compressed) == (fmt, True)
    assert got["c.cram"].format == "cram" and got["notes.dat"].format == "unknown"
    assert got["s.fasta"].index_present and got["s.vcf.gz"].index_present and not got["s.vcf"].index_present
    estimates = {"s.fasta": 4, "s.fastq": 3, "s.vcf": 6, "s.bed": 4, "s.gff": 4, "s.sam": 5, "me.txt": 6, "s.vcf.gz": 6}
    assert {n: got[n].record_estimate for n in estimates} == estimates
    assert got["me.txt"].assembly == "GRCh37" and got["c.cram"].record_estimate is None


def test_fasta(spark, data):
    s = R.read_fasta(spark, f"{data}/s.fasta")
    assert rows(s.select("seq_id", F.length("sequence")), "record_no") == [("ctgA", 15), ("ctgB", 13), ("ctgC", 8), ("ctgD", 2)]
    f = S.fasta_summary(s).first()
    assert (f.n_sequences, f.total_length, f.min_length, f.max_length, f.median_length, f.ambiguous_bases) == (4, 38, 2, 15, 10, 4)
    assert f.n50 == 13 and f.mean_length == 9.5
    assert rows(S.fasta_table(s).select("id", "gc"), "id")[2] == ("ctgC", 100.0)
    assert S.slice_sequence(s, "ctgA", 4, 9).first() == ("ctgA:4-9", "TTGCAA")


def test_fasta_and_lines_survive_splitting(spark, tmp_path):
    recs = [(f"s{i} > note", "ACGT" * (i % 7 + 1)) for i in range(400)]
    (tmp_path / "b.fa").write_text("".join(f">{h}\n{q[:9]}\n{q[9:]}\n" for h, q in recs))
    (tmp_path / "b.fq").write_text("".join(f"@r{i}\n{q}\n+\n{'@' * len(q)}\n" for i, (_, q) in enumerate(recs)))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        fa = R.read_fasta(spark, str(tmp_path / "b.fa"))
        assert fa.rdd.getNumPartitions() > 5
        assert rows(fa.select("description", "sequence"), "record_no") == recs
        lines = L.numbered_lines(spark, str(tmp_path / "b.fq"))
        assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(1, 1601))
        fq = R.read_fastq(spark, str(tmp_path / "b.fq"))
        assert rows(fq.select("name", "seq"), "read_no") == [(f"r{i}", q) for i, (_, q) in enumerate(recs)]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_fastq(spark, data, tmp_path):
    r = R.read_fastq(spark, f"{data}/s.fastq")
    f = S.fastq_summary(r).first()
    assert (f.read_count, f.phred_offset) == (3, 33) and f.mean_quality == pytest.approx(315 / 13)
    per = rows(S.per_base_mean_quality(r).select("cycle", "mean_quality"), "cycle")
    assert [m for _, m in per] == pytest.approx([65 / 3, 25, 85 / 3, 22.5, 22.5])
    (tmp_path / "cut.fq").write_text("@a\nAC\n+\nII\n@b\n\n+\n\n@c\nAC\n+\nII\n")
    assert [x.name for x in R.read_fastq(spark, str(tmp_path / "cut.fq")).collect()] == ["a"]


def test_phred_ranges(spark):
    df = spark.createDataFrame([("a", "I"), ("b", "#I"), ("c", "Ih"), ("d", "KK")], "path string, qual string")
    got = {r.path: (r.phred_offset, r.ambiguous) for r in S.quality_range(df).collect()}
    assert got == {"a": (33, True), "b": (33, False), "c": (64, False), "d": (64, False)}


def test_qc_tables(spark):
    reads = spark.createDataFrame(
        [("f", 1, "ACGN", "IIII"), ("f", 2, "ACG", "III#"), ("f", 3, "ACG", "5II")], "path string, read_no bigint, seq string, qual string")
    t = jobs.qc_report_tables(reads)
    assert t["totals"].first()[1:4] == (3, 10, 1)
    box = {r.cycle: r for r in t["per_base_quality"].collect()}
    assert (box[3].n_reads, box[0].median, box[0].q1) == (2, 40.0, 30.0)
    assert rows(t["overrepresented"].select("seq", "n_reads", "first_read"), "rank")[0] == ("ACG", 2, 2)
    assert rows(t["n_content"].select("cycle", "n_count", "n_reads"), "cycle")[3] == (3, 1, 1)
    assert sum(r.n_reads for r in t["length"].collect()) == 3
    assert {r.bin for r in t["length"].collect()} == {0, 39}
    assert rows(S.per_base_mean_quality(reads).select("cycle"), "cycle")[-1] == (3,)


def test_vcf(spark, data):
    v = R.read_vcf(spark, f"{data}/s.vcf")
    s = V.variant_summary(v).first()
    assert (s.variant_count, s.snv, s.indel, s.mnp, s.sv, s.pass_count, s.filtered_count) == (6, 3, 2, 1, 0, 5, 1)
    assert s.ts_tv_ratio == 2.0
    assert rows(V.variants_by_chrom(v), "chrom") == [("7", 3), ("8", 3)]
    h = R.vcf_header(spark, f"{data}/s.vcf").first()
    assert (h.info_ids, h.format_ids, h.samples) == (["AF", "DB"], ["AD", "GT"], ["subjA", "subjB"])
    wide = V.flatten_format(V.flatten_info(v, h.info_ids), h.samples, h.format_ids)
    at = {r["pos"]: r for r in wide.collect()}
    assert [at[1200][c] for c in ("AF", "DB", "subjA.GT", "subjA.AD", "subjB.AD")] == ["0.5", "", "0/1", "4", "9,0"]
    assert (at[1300]["DB"], at[1300]["subjB.GT"], at[300]["AF"], at[410]["AF"]) == ("True", "./.", "0.3", "0.4")
    long = V.explode_samples(v, h.samples)
    assert rows(long.filter("pos = 1200").select("sample", "key", "value"), "sample", "key") == [
        ("subjA", "AD", "4"), ("subjA", "GT", "0/1"), ("subjB", "AD", "9,0"), ("subjB", "GT", "0/0")]
    assert [r.pos for r in V.slice_variants(v, "7", 1452, 1500).collect()] == [1450]
    assert rows(V.frameshift_candidates(v).select("pos"), "pos") == [(1450,)]
    assert rows(V.filtered_out(v).select("pos", "filter")) == [(1450, "lowq")]
    assert V.top_quality(v).first().qual == 99.0


def test_info_flags_and_missing_formats(spark):
    v = spark.createDataFrame([("DB;AF=0.1,0.2;X=", "GT:AD", ["./.:3", "."])], "info string, format string, sample_values array<string>")
    r = V.flatten_info(v, ["DB", "AF", "NO"]).first()
    assert (r.DB, r.AF, r.NO) == ("True", "0.1,0.2", "")
    got = {(x.sample, x.key): x.value for x in V.explode_samples(v, ["a", "b"]).collect()}
    assert got == {("a", "GT"): "./.", ("a", "AD"): "3", ("b", "GT"): "./.", ("b", "AD"): ""}


def test_sam(spark, data):
    a, c = R.read_sam(spark, f"{data}/s.sam"), R.sam_contigs(spark, f"{data}/s.sam")
    s = A.alignment_summary(a).first()
    assert (s.read_count, s.mapped, s.unmapped, s.duplicates, s.aligned_bases) == (5, 4, 1, 1, 23)
    assert A.mean_coverage(a, c).first().mean_coverage == pytest.approx(23 / 3000)
    assert [r.qname for r in A.slice_reads(a, "chr5", 57, 300).collect()] == ["q2"]


def test_bed_gff(spark, data):
    b, g, t = R.read_bed(spark, f"{data}/s.bed"), R.read_gff(spark, f"{data}/s.gff"), R.read_gff(spark, f"{data}/s.gtf")
    assert rows(I.span_by_chrom(b).select("chrom", "span"), "chrom") == [("chr4", 1260), ("chrX", 1)]
    assert rows(I.feature_summary(g), "feature_type") == [("CDS", 2), ("mRNA", 2)]
    assert I.bed_to_gff(b).orderBy("seqid", "start1").first()[0:5] == ("chr4", "bed2gff", "region", 11, 60)
    assert [r.name for r in I.gff_to_bed(g).orderBy("chrom", "start0", "name").collect()] == ["cds9", "tx9", "cds10", "tx8"]
    assert [r.name for r in I.gff_to_bed(t).orderBy("chrom", "start0").collect()] == ["gA", "gB"]
    assert I.slice_bed(b, "chr4", 60, 500).count() == 1 and I.slice_bed(b, "chr4", 61, 500).count() == 0
    assert I.slice_gff(g, "5", 41, 69).count() == 1


def test_lookup_and_slices(spark, data):
    c = calls(spark, data, "me.txt")
    asked = C.id_list(spark, "rs5033, rs5012,rs77,rs5033")
    got = rows(C.lookup_calls(asked, c).select("rsid", "chrom", "pos", "genotype", "req_no"), "req_no")
    assert got == [("rs5033", "9", "7100", "AC", 1), ("rs5012", "3", "41000", "CT", 2), ("rs77", "", "", "not_tested", 3),
                   ("rs5033", "9", "7100", "AC", 4)]
    assert rows(C.id_list(spark, ["# x", " rs9 extra", "", "rs9"])) == [(1, "rs9"), (2, "rs9")]
    r = calls(spark, data, "regions.txt")
    cut = lambda s: [x.rsid for x in C.slice_calls(r, *C.parse_region(s)).orderBy("line_no").collect()]
    assert cut("5:2500-4000") == ["rs710", "rs720"] and cut("5:4000-9000") == ["rs720", "rs730"]
    assert cut("Y:1-400") == ["rsY1"] and cut("MT:10-200") == ["rsM1", "rsM2"] and cut("chr5:1-4000") == []
    for bad in ("1", "1:5", "1:a-b"):
        with pytest.raises(ValueError):
            C.parse_region(bad)
    with pytest.raises(ValueError, match="available columns"):
        C.project_columns(c, ["rsid", "nope"])
    with pytest.raises(ValueError, match="non-empty"):
        C.project_columns(c, [" "])


def test_calls_to_vcf(spark, data, tmp_path):
    c, m = calls(spark, data, "me.txt"), R.read_site_map(spark, f"{data}/map.tsv")
    v = C.calls_to_vcf(c, m)
    assert rows(v.select("id", "gt"), "id") == [("rs5012", "0/1"), ("rs5020", "0/0"), ("rs5033", "0/1")]
    assert rows(C.conversion_accounting(c, m).select("emitted", "unmapped", "no_call_skipped")) == [(3, 2, 1)]
    out = str(tmp_path / "vcf")
    W.write_vcf(v, out)
    body = spark.read.text(out + "/sample_id=me")
    assert body.count() == 3 and spark.read.text(out + "_header").count() == 5


def test_manifest_and_site_map(spark, data):
    chip = R.read_chip_manifest(spark, f"{data}/chip.csv")
    assert [r.rsid for r in chip.orderBy("rsid").collect()] == ["rs1", "rs2", "rs4"]
    out = jobs.build_site_map([chip], R.read_dbsnp_sites(spark, f"{data}/dbsnp.vcf"))
    assert rows(out["sites"], "rsid") == [("rs1", "1", 10, "A", "G"), ("rs2", "1", 20, "C", "T"), ("rs4", "2", 50, "G", "C")]
    assert out["coverage"].first()[0:3] == (3, 3, 100.0)


def test_site_map_choice(spark, data, tmp_path):
    assert R.first_site_map(spark, None, str(tmp_path / "none.tsv"), f"{data}/map.tsv").count() == 4
    with pytest.raises(FileNotFoundError):
        R.first_site_map(spark, str(tmp_path / "none.tsv"))


def test_round_trips(spark, data, tmp_path):
    s = R.read_fasta(spark, f"{data}/s.fasta")
    W.write_fasta(s.select(F.col("description").alias("header"), "sequence"), str(tmp_path / "fa"), width=5)
    back = R.read_fasta(spark, str(tmp_path / "fa"))
    assert rows(back.select("seq_id", "sequence"), "seq_id") == rows(s.select("seq_id", "sequence"), "seq_id")
    b = R.read_bed(spark, f"{data}/s.bed")
    W.write_bed(b, str(tmp_path / "bed"))
    assert rows(R.read_bed(spark, str(tmp_path / "bed")).drop("path", "line_no"), "chrom", "start0") == rows(b.drop("path", "line_no"), "chrom", "start0")
    W.write_gff(I.bed_to_gff(b), str(tmp_path / "gff"))
    assert rows(R.read_gff(spark, str(tmp_path / "gff")).select("chrom", "start0", "end0"), "chrom", "start0") == rows(b.select("chrom", "start0", "end0"), "chrom", "start0")


def test_tables_by_header(spark, tmp_path):
    p = tmp_path / "INDEX.tsv"
    p.write_text("found\trsid\tgenotype\ny\trs1\tAG\nn\trs2\t--\nshort\ny\trs1\tGG\n")
    assert rows(R.read_index(spark, str(p)), "rsid") == [("rs1", "GG", "y"), ("rs2", "--", "n")]
    with pytest.raises(ValueError, match="missing column"):
        R.read_cpic(spark, str(p))
    with pytest.raises(ValueError, match="is not"):
        R.read_table(spark, str(p), ("rsid", "genotype"), exact=True)
    with pytest.raises(Exception, match="malformed row"):
        R.read_table(spark, str(p), ("found", "rsid", "genotype"), exact=True).collect()
    lst = tmp_path / "phrases.txt"
    lst.write_text("# c\n\\bmay\\b\n\n\\bbest\\b\n")
    assert R.read_phrases(spark, str(lst)) == ["\\bmay\\b", "\\bbest\\b"]
    assert R.read_terms("b, a,#x,b") == ["a", "b"]
    js = tmp_path / "allow.json"
    js.write_text('{"_comment": "x", "pubmed": {"url_template": "t/{id}", "url_root": "t/", "ext": "html"}}')
    assert rows(R.read_allowlist(spark, str(js))) == [("pubmed", "t/{id}", "t/", "html")]
    assert R.read_allowlist(spark).count() == 8


def test_headers_per_file(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("rsid\tgenotype\tfound\nrs1\tAG\ty\n")
    (tmp_path / "b.tsv").write_text("found\textra\tgenotype\trsid\nn\tz\t--\trs2\nshort\n")
    got = R.read_table(spark, str(tmp_path), ("rsid", "genotype")).drop("line_no")
    assert rows(got, "rsid") == [("rs1", "AG"), ("rs2", "--")]
    with pytest.raises(ValueError, match="is not .* in .*b.tsv"):
        R.read_table(spark, str(tmp_path), ("rsid", "genotype", "found"), exact=True)
    (tmp_path / "c.tsv").write_text("rsid\nrs3\n")
    with pytest.raises(ValueError, match="missing column.*genotype.*c.tsv"):
        R.read_table(spark, str(tmp_path), ("rsid", "genotype"))


def test_files_as_they_are(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    texts = {"one.md": "first\nlines\n", "sub/two.md": "x", "empty.md": "", "sub/_hidden.md": "under", ".dot.md": "dotted", "no.txt": "n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {r.doc: r.text for r in R.read_docs(spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in texts.items() if k.endswith(".md")}
    listed = L.listing(spark, str(tmp_path), recursiveFileLookup="true")
    assert listed.count() == 6 and listed.filter("length = 0").count() == 1 and L.listing(spark, str(tmp_path)).count() == 4
    sums = {r.path.removeprefix(f"{tmp_path}/"): r.sha256 for r in W.file_fingerprint(spark, str(tmp_path), recursiveFileLookup="true").collect()}
    assert sums == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in texts.items()}


def test_long_files_are_no_obstacle(spark, tmp_path):
    (tmp_path / "c").write_bytes(b"CRAM" + b"x" * 4000)
    (tmp_path / "z").write_bytes(gzip.compress(b"@a\nAC\n+\nII\n" * 50, mtime=0))
    (tmp_path / "r.bed").write_text("chr1\t0\t5\n" * 20_000)
    (tmp_path / "e.vcf").write_text("")
    old = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        got = {r.path.rsplit("/", 1)[1]: r for r in L.file_catalog(spark, str(tmp_path)).collect()}
        sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in W.file_fingerprint(spark, str(tmp_path)).collect()}
        assert sums == {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("c", "z", "r.bed", "e.vcf")}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", old)
    assert set(got) == {"c", "z", "r.bed", "e.vcf"} and got["c"].format == "cram"
    assert got["z"].gzip_mismatch and not got["r.bed"].gzip_mismatch
    assert got["r.bed"].record_estimate == pytest.approx(20_000, rel=0.01) and got["e.vcf"].size_bytes == 0


def test_fastq_header_is_checked(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a\nAC\n+\nII\n>b\nAC\n+\nII\n")
    with pytest.raises(Exception, match="no FASTQ header: >b"):
        R.read_fastq(spark, str(tmp_path / "x.fq")).collect()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from locusgrid import session

    conf = {}
    cluster = SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=SimpleNamespace(master="spark://h:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)
    conf["spark.checkpoint.dir"] = "hdfs://shared"
    assert session.scratch_path(cluster, "x").startswith("hdfs://shared/x-")
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_dir(spark) and spark.conf.get("spark.checkpoint.dir", None) == before


def test_specs(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_id": "d", "title": "t", "group": "g", "provenance": {"doc_id": "d", "phase": 3}, "findings": [{"gene": "G", "tier": 1, "triples": [{"rsid": "rs1"}]}]}')
    (tmp_path / "b.json").write_text('{"doc_id": "e", "group": ""}')
    got = {r.doc_id: r for r in R.read_specs(spark, str(tmp_path)).collect()}
    assert got["d"].reasons == [] and got["d"].findings[0].triples[0].rsid == "rs1" and got["d"].provenance.phase == 3
    assert got["e"].reasons == ["missing title", "missing group", "missing provenance"]


def test_fixed_round(spark):
    df = spark.createDataFrame([(1.0005,), (33.335,), (2.5,), (1234567.0625,)], "x double")
    assert [r[0] for r in df.select(fixed_round(F.col("x"), 3)).collect()] == [round(x, 3) for x in (1.0005, 33.335, 2.5, 1234567.0625)]


def test_a_large_sample_is_exported_as_several_files(spark):
    from locusgrid import catalog_io
    from locusgrid.catalog import Views

    v = Views(spark, "/root/testdata/sf0.001")
    path = catalog_io._export(v, "23andme", file_rows=100)
    got = catalog_io._back(v, path)
    calls = v.calls.selectExpr("sample_id", "concat_ws('_', rsid, cast(line_no as string)) as rsid", "chrom", "pos", "genotype")
    assert sorted(map(str, got.select(*calls.columns).collect())) == sorted(map(str, calls.collect()))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).count()
    sizes = {r.sample_id: r["count"] for r in calls.groupBy("sample_id").count().collect()}
    assert files == sum(-(-n // 100) for n in sizes.values()) > len(sizes)


def test_vcf_files_of_many_samples_are_written_without_side_files(spark, tmp_path):
    import os

    ids = ["a", "b/c=d%", "", None, "x [1]", "\u00e9"] + [f"s{i}" for i in range(50)]
    cols = "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string, format string, gt string"
    df = spark.createDataFrame([(i, "1", k, "rs1", "A", "G", ".", "PASS", ".", "GT", "0/1") for i in ids for k in range(2)], "sample_id string, " + cols)
    W.write_vcf(df, str(tmp_path / "vcf"))
    df.select("sample_id", F.lit("x").alias("value")).write.partitionBy("sample_id").text(str(tmp_path / "spark"))
    own, theirs = ({d for d in os.listdir(tmp_path / n) if "=" in d} for n in ("vcf", "spark"))
    assert own == theirs and len(own) == len(ids) - 1
    files = [f for _, _, names in os.walk(tmp_path / "vcf") for f in names]
    assert len(files) == len(own)  # a partitioned write leaves a checksum beside each
    back = spark.read.text(str(tmp_path / "vcf"))
    assert back.count() == 2 * len(ids) and back.select("sample_id").distinct().count() == len(own)
