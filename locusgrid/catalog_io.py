"""Registered queries that write a view as text files to the shared folder and read it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import AUDIT, INDEX, LAST_SAMPLE, SOURCES, OC, OD, OI, OS, OV, OA, jobs, query
from .catalog_docs import KNOWN, _discover
from .operators import keyed as OK
from .operators.keyed import last_wins
from .session import scratch_path
from .sources import formats as R
from .sources import lines as L
from .sources import sinks as W


# About the calls of one exported file; a sample of more has several files.
EXPORT_ROWS = 1_000_000
EXPORT_FOLDERS = 256


def _export(v, layout, file_rows=EXPORT_ROWS):
    """The calls of the whole view in a vendor layout, in files ``sample_id=-part=``: a sample's calls are dealt by line
    number over as many files as they need, so no task writes a whole large sample. Each file carries its own header
    lines because a file's layout is found from its head. The files share a few folders, so a cohort of many samples
    isn't a folder for each."""
    c = v.calls.withColumn("rsid", F.concat_ws("_", "rsid", F.col("line_no").cast("string")))
    a1, a2 = F.substring("genotype", 1, 1), F.substring("genotype", 2, 1)
    pos = F.col("pos").cast("string")
    if layout == "23andme":
        head = "# This data file generated by 23andMe\n# build 37\n# rsid\tchromosome\tposition\tgenotype"
        row = F.concat_ws("\t", "rsid", "chrom", pos, "genotype")
    elif layout == "ancestrydna":
        head = "#AncestryDNA raw data download\n#GRCh38\nrsid\tchromosome\tposition\tallele1\tallele2"
        row = F.concat_ws("\t", "rsid", "chrom", pos, a1, a2)
    else:
        head = "# MyHeritage DNA raw data.\nRSID,CHROMOSOME,POSITION,RESULT"
        row = F.concat(F.lit('"'), F.concat_ws('","', "rsid", "chrom", pos, "genotype"), F.lit('"'))
    path = scratch_path(v.spark, layout)
    sizes = c.groupBy("sample_id").agg(F.ceil(F.count(F.lit(1)) / file_rows).alias("_parts"))
    c = c.join(sizes, "sample_id").withColumn("part", F.pmod("line_no", "_parts"))
    rows = c.select("sample_id", "part", row.alias("value")).repartition("sample_id", "part").sortWithinPartitions("sample_id", "part")
    name = F.format_string("%03d/sample_id=%d-part=%d.txt", F.pmod("sample_id", F.lit(EXPORT_FOLDERS)), "sample_id", "part")
    R.ranges.write_lines(rows.select(name.alias("name"), "value"), R.ranges.qualified(v.spark, path), head)
    return path


CALLS_SQL = """
select sample_id, rsid || '_' || line_no as rsid, chrom, pos, genotype from v_calls"""


def _back(v, path):
    got = R.read_calls(v.spark, path, recursiveFileLookup="true")
    sample = F.regexp_extract("path", "sample_id=([0-9]+)", 1).cast("bigint")
    return got.select(sample.alias("sample_id"), "rsid", "chrom", "pos", "genotype")


@query("read_calls_23andme", "v_calls", CALLS_SQL)
def _(v):
    return _back(v, _export(v, "23andme"))


@query("read_calls_ancestry", "v_calls", CALLS_SQL)
def _(v):
    return _back(v, _export(v, "ancestrydna"))


@query("read_calls_myheritage", "v_calls", CALLS_SQL)
def _(v):
    return _back(v, _export(v, "myheritage"))


@query("export_files", "v_calls", """
select sample_id, 'ancestrydna' as vendor, 'GRCh38' as assembly, 3::bigint as first_data_line from v_calls group by sample_id""")
def _(v):
    files = R.export_facts(v.spark, _export(v, "ancestrydna"), recursiveFileLookup="true")
    return files.select(F.regexp_extract("path", "sample_id=([0-9]+)", 1).cast("bigint").alias("sample_id"),
                        "vendor", "assembly", "first_data_line")


@query("source_line_accounting", "v_calls", """
select sample_id, count(*) + 3 as total_lines, 2::bigint as comment_lines, 1::bigint as header_lines, count(*) as data_rows, 0::bigint as blank_lines, 0::bigint as malformed_rows from v_calls group by sample_id""")
def _(v):
    lines = L.raw_lines(v.spark, _export(v, "ancestrydna"), recursiveFileLookup="true")
    return L.source_line_accounting(lines, 5).withColumn(
        "sample_id", F.regexp_extract("path", "sample_id=([0-9]+)", 1).cast("bigint")).drop("path")


@query("file_catalog", "v_calls", """
select sample_id, 'consumer_dna:23andme' as format, false as compressed, false as index_present, 'GRCh37' as assembly from v_calls group by sample_id""")
def _(v):
    files = L.file_catalog(v.spark, _export(v, "23andme"), recursiveFileLookup="true")
    return files.select(F.regexp_extract("path", "sample_id=([0-9]+)", 1).cast("bigint").alias("sample_id"),
                        "format", "compressed", "index_present", "assembly")


@query("estimate_records", "v_calls", "select sample_id, count(*) as record_estimate from v_calls group by sample_id")
def _(v):
    files = L.file_catalog(v.spark, _export(v, "23andme"), recursiveFileLookup="true")
    return files.select(F.regexp_extract("path", "sample_id=([0-9]+)", 1).cast("bigint").alias("sample_id"),
                        "record_estimate")


@query("archive_count", "v_calls", "select count(distinct sample_id) as n_files from v_calls")
def _(v):
    return L.listing(v.spark, _export(v, "23andme"), recursiveFileLookup="true").agg(F.count(F.lit(1)).alias("n_files"))


@query("read_fasta", "v_reads", "select 'r' || read_id as seq_id, seq as sequence from v_reads")
def _(v):
    path = scratch_path(v.spark, "fasta")
    W.write_fasta(OS.reads_to_sequences(v.reads), path)
    return R.read_fasta(v.spark, path).select("seq_id", "sequence")


@query("read_fastq", "v_reads", "select 'r' || read_id as name, seq, qual from v_reads where length(qual) > 0")
def _(v):
    path = scratch_path(v.spark, "fastq")
    W.write_fastq(v.reads, path)
    return R.read_fastq(v.spark, path).select("name", "seq", "qual")


@query("read_vcf", "v_variants", """
select chrom, pos, id, ref, alt, floor(qual) as qual, filter, svtype, cast(row_id as varchar) as rid from v_variants""")
def _(v):
    path = scratch_path(v.spark, "vcf")
    x = v("v_variants")
    info = F.concat(F.lit("RID="), F.col("row_id").cast("string"),
                    F.when(F.col("svtype").isNotNull(), F.concat(F.lit(";SVTYPE="), "svtype")).otherwise(F.lit("")))
    qual = F.coalesce(F.floor("qual").cast("string"), F.lit("."))
    x.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", qual, "filter", info)
             .alias("value")).write.text(path)
    got = R.read_vcf(v.spark, path)
    rid = F.element_at(F.split("info", "[=;]"), 2)
    return got.select("chrom", "pos", "id", "ref", "alt", "qual", "filter", "svtype", rid.alias("rid"))


@query("flatten_info", "v_variants", """
select row_id, cast(pos as varchar) as "DP", case when svtype is not null then 'True' else '' end as "DB", '' as "XX" from v_variants""")
def _(v):
    flag = F.when(F.col("svtype").isNotNull(), F.lit(";DB")).otherwise(F.lit(""))
    x = v("v_variants").withColumn("info", F.concat(F.lit("DP="), F.col("pos").cast("string"), flag))
    return OV.flatten_info(x, ["DP", "DB", "XX"]).select("row_id", "DP", "DB", "XX")


@query("explode_samples", "v_variants", """
select row_id, s as sample, k as key, case when k = 'GT' then case when s = 'A' then '0/1' when row_id % 2 = 0 then './.' else '1|1' end when s = 'A' then cast(pos as varchar) else '' end as value
from v_variants cross join (values ('A'), ('B')) a(s) cross join (values ('GT'), ('AD')) b(k)""")
def _(v):
    b = F.when(F.col("row_id") % 2 == 0, F.lit(".")).otherwise(F.lit("1|1:."))
    x = v("v_variants").select(
        "row_id", F.lit("GT:AD").alias("format"),
        F.array(F.concat(F.lit("0/1:"), F.col("pos").cast("string")), b).alias("sample_values"))
    return OV.explode_samples(x, ["A", "B"])


@query("flatten_format", "v_variants", """
select row_id, '0/1' as "A.GT", cast(pos as varchar) as "A.AD", case when row_id % 2 = 0 then './.' else '1|1' end as "B.GT", '' as "B.AD" from v_variants""")
def _(v):
    b = F.when(F.col("row_id") % 2 == 0, F.lit(".")).otherwise(F.lit("1|1:."))
    x = v("v_variants").select(
        "row_id", F.lit("GT:AD").alias("format"),
        F.array(F.concat(F.lit("0/1:"), F.col("pos").cast("string")), b).alias("sample_values"))
    return OV.flatten_format(x, ["A", "B"], ["GT", "AD"])


def _sam(v):
    path = scratch_path(v.spark, "sam")
    n = F.length("seq").cast("string")
    row = F.concat_ws(
        "\t", "name", F.when(F.col("read_no") % 5 == 0, "4").when(F.col("read_no") % 7 == 0, "1024").otherwise("0"),
        F.concat(F.lit("chr"), (1 + F.col("read_no") % 3).cast("string")), (F.col("read_no") * 10 + 1).cast("string"), F.lit("60"),
        F.concat(n, F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual")
    v.reads.select(row.alias("value")).write.text(path)
    return path


def _sam_header(v):
    """Contigs of the test alignments as a header file; lengths follow the furthest read."""
    path = scratch_path(v.spark, "sam_header")
    far = v.reads.groupBy((1 + F.col("read_no") % 3).alias("k")).agg(F.max(F.col("read_no") * 10 + F.length("seq")).alias("ln"))
    far.select(F.concat(F.lit("@SQ\tSN:chr"), F.col("k").cast("string"), F.lit("\tLN:"), F.col("ln").cast("string")).alias("value")).write.text(path)
    return path


@query("read_sam", "v_reads", """
select 'r' || read_id as qname, case when read_id % 5 = 0 then 4 when read_id % 7 = 0 then 1024 else 0 end as flag, 'chr' || (1 + read_id % 3) as rname,
  read_id * 10 + 1 as pos, length(seq) || 'M' as cigar, seq from v_reads""")
def _(v):
    return R.read_sam(v.spark, _sam(v)).select("qname", "flag", "rname", "pos", "cigar", "seq")


@query("alignment_summary", "v_reads", """
select 'chr' || (1 + read_id % 3) as rname, count(*) as read_count, count(*) filter (where read_id % 5 <> 0) as mapped, count(*) filter (where read_id % 5 = 0) as unmapped,
  count(*) filter (where read_id % 5 <> 0 and read_id % 7 = 0) as duplicates, cast(sum(length(seq)) filter (where read_id % 5 <> 0) as bigint) as aligned_bases,
  cast(count(*) filter (where read_id % 5 <> 0 and read_id % 7 = 0) as double) / count(*) as duplicate_rate from v_reads group by 1""")
def _(v):
    return OA.alignment_summary(R.read_sam(v.spark, _sam(v)), ["rname"])


@query("mean_coverage", "v_reads", """
select aligned_bases, reference_length, aligned_bases / reference_length as mean_coverage from
(select cast(sum(length(seq)) filter (where read_id % 5 <> 0) as bigint) as aligned_bases, 
  (select cast(sum(ln) as bigint) from (select max(read_id * 10 + length(seq)) as ln from v_reads group by read_id % 3)) as reference_length from v_reads)""")
def _(v):
    a = R.read_sam(v.spark, _sam(v)).withColumn("path", F.lit("all"))
    contigs = R.sam_contigs(v.spark, _sam_header(v)).select(F.lit("all").alias("path"), "length")
    return OA.mean_coverage(a, contigs).drop("path")


@query("slice_reads", "v_reads", """
select 'r' || read_id as qname from v_reads where read_id % 3 = 1 and read_id % 5 <> 0 and read_id * 10 + 1 <= 4000 and read_id * 10 + greatest(length(seq), 1) >= 1500""")
def _(v):
    return OA.slice_reads(R.read_sam(v.spark, _sam(v)), "chr2", 1500, 4000).select("qname")


@query("read_bed", "v_features", "select chrom, start0, end0, 'f' || feature_id as name, '.' as score, strand from v_features")
def _(v):
    path = scratch_path(v.spark, "bed")
    W.write_bed(OI.gff_to_bed(v.gff), path)
    return R.read_bed(v.spark, path).drop("path", "line_no")


@query("read_gff", "v_features", """
select chrom, source, feature_type, start0, end0, strand, attributes from v_features""")
def _(v):
    path = scratch_path(v.spark, "gff")
    g = v.gff.select(F.col("chrom").alias("seqid"), "source", "feature_type", "start1", "end1", "score", "strand",
                     F.lit(".").alias("phase"), "attributes")
    W.write_gff(g, path)
    return R.read_gff(v.spark, path).select("chrom", "source", "feature_type", "start0", "end0", "strand", "attributes")


@query("read_gtf", "v_features", "select chrom, start0, end0, 'g' || feature_id as name, '.' as score, strand from v_features")
def _(v):
    path = scratch_path(v.spark, "gtf")
    attributes = F.concat(F.lit('gene_id "g'), F.col("feature_id").cast("string"), F.lit('"; transcript_id "t"'))
    g = v.gff.select(F.col("chrom").alias("seqid"), "source", "feature_type", "start1", "end1", "score", "strand",
                     F.lit(".").alias("phase"), attributes.alias("attributes"))
    W.write_gff(g, path)
    return OI.gff_to_bed(R.read_gff(v.spark, path))


@query("read_site_map", "v_rsmap", "select * from v_rsmap")
def _(v):
    path = scratch_path(v.spark, "map")
    m = v("v_rsmap").select(F.concat_ws("\t", "rsid", "chrom", F.col("pos").cast("string"), "ref", "alt").alias("value"))
    m.write.option("compression", "gzip").text(path)
    return R.read_site_map(v.spark, path)


@query("read_dbsnp_sites", "v_variants", "select chrom, pos, id, ref, alt from v_variants")
def _(v):
    path = scratch_path(v.spark, "dbsnp")
    v("v_variants").select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", F.lit("."), F.lit("."),
                                       F.lit("A=1\tB=2\tC")).alias("value")).write.text(path)
    return R.read_dbsnp_sites(v.spark, path)


@query("read_chip_manifest", "v_rsmap", "select rsid from v_rsmap where cast(substr(rsid, 3) as bigint) % 7 <> 0")
def _(v):
    path = scratch_path(v.spark, "chip")
    rs = v("v_rsmap")
    name = F.when(F.substr("rsid", F.lit(3)).cast("bigint") % 7 == 0, F.concat(F.lit("cnv"), "rsid")).otherwise(F.col("rsid"))
    row = F.concat(F.lit("id,"), name, F.lit(",x"))
    body = rs.select(F.when(F.monotonically_increasing_id() % (1 << 33) == 0,
                            F.concat(F.lit("[Header]\nName,z\n[Assay]\nIlmnID,Name,Chr\n"), row)).otherwise(row).alias("value"))
    body.write.text(path)
    return R.read_chip_manifest(v.spark, path).select("rsid").distinct()


@query("read_clinvar", "v_clinvar", "select rsid, pathogenic_allele, gene, vcv, significance from v_clinvar")
def _(v):
    path = scratch_path(v.spark, "clinvar")
    W.write_table(v("v_clinvar"), path)
    return R.read_clinvar(v.spark, path)


@query("read_cpic", "v_cpic", "select gene, drug, level, defining_rsids from v_cpic")
def _(v):
    path = scratch_path(v.spark, "cpic")
    W.write_table(v("v_cpic"), path)
    return R.read_cpic(v.spark, path)


def _written_order(got, *columns):
    """Rows as they stand in the files that a sorted write left, numbered from 1. Part files follow each other by name, and
    rows of a file by place."""
    files = got.select(*columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
                       F.monotonically_increasing_id().alias("_id"))
    at = files.withColumn("_row", F.row_number().over(Window.partitionBy("_file").orderBy("_at", "_id")))
    before = files.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select(
        "_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return at.join(before, "_file").withColumn("written", F.col("_before") + F.col("_row")).drop("_file", "_at", "_id", "_row", "_before")


@query("write_index", "v_docs v_calls", """
select rsid, genotype, found from idx""", INDEX)
def _(v):
    path = scratch_path(v.spark, "index")
    W.write_index(v.index, OD.citing_docs(v.docs), path)
    return R.read_index(v.spark, path)


# All columns as written, and their order: the pool's.
@query("write_index_rows", "v_docs v_calls", """
select rsid, chromosome, position, genotype, found, source_docs, '0' as discovered_in_phase, cast(part_no as varchar) as part_no,
  row_number() over (order by first_doc, first_pos, part_no) as written from idx join d_list using (rsid)""", INDEX + "," + SOURCES)
def _(v):
    path = scratch_path(v.spark, "index")
    W.write_index(v.index, OD.citing_docs(v.docs), path)
    columns = ("rsid", "chromosome", "position", "genotype", "found", "source_docs", "discovered_in_phase", "part_no")
    got = _written_order(v.spark.read.csv(path, sep="\t", header=True, quote="", escape=""), *columns)
    return got.fillna("", ["chromosome", "position", "source_docs"])


@query("index_source_docs", "v_docs v_calls", """
select rsid, chromosome, position, genotype, found, (select string_agg(doc, ',' order by doc) from (select distinct cast(doc as varchar) as doc, rsid from d_tok) t where t.rsid = idx.rsid) as source_docs from idx""", INDEX)
def _(v):
    return W.index_sources(v.index, OD.citing_docs(v.docs)).select(
        "rsid", "chromosome", "position", "genotype", "found", "source_docs")


@query("append_index", "v_docs v_calls", """
select rsid, genotype, 0 as discovered_in_phase from idx union all select 'new' || rsid, genotype, 6 from idx""", INDEX)
def _(v):
    path = scratch_path(v.spark, "index_parquet")
    base = v.index.drop("first_doc", "first_pos")
    W.append_index(base, path)
    W.append_index(base.withColumns({"rsid": F.concat(F.lit("new"), "rsid"), "discovered_in_phase": F.lit(6)}), path)
    return v.spark.read.parquet(path).select("rsid", "genotype", "discovered_in_phase")


@query("write_vcf", "v_calls v_rsmap", """
select c.sample_id, c.chrom, c.rsid as id, count(*) as n from c_last c join v_rsmap m using (rsid) where c.genotype <> '--' group by all""", LAST_SAMPLE)
def _(v):
    path = scratch_path(v.spark, "calls_vcf")
    W.write_vcf(OC.calls_to_vcf(last_wins(v.calls, ["sample_id", "rsid"]), v("v_rsmap")), path)
    got = R.read_vcf(v.spark, path, recursiveFileLookup="true")
    sample = F.regexp_extract("path", "sample_id=([0-9]+)", 1).cast("bigint")
    return got.groupBy(sample.alias("sample_id"), "chrom", "id").agg(F.count(F.lit(1)).alias("n"))


@query("write_vcf_rows", "v_calls v_rsmap", """
select c.sample_id, m.chrom, m.pos, c.rsid as id, ref, alt, cast(null as double) as qual, 'PASS' as filter, '.' as info, 'GT' as format,
  concat(case substr(genotype, 1, 1) when ref then '0' when alt then '1' else '.' end, '/', case substr(genotype, 2, 1) when ref then '0' when alt then '1' else '.' end) as gt
from c_last c join v_rsmap m using (rsid) where c.genotype <> '--'""", LAST_SAMPLE)
def _(v):
    path = scratch_path(v.spark, "calls_vcf")
    W.write_vcf(OC.calls_to_vcf(last_wins(v.calls, ["sample_id", "rsid"]), v("v_rsmap")), path)
    got = R.read_vcf(v.spark, path, recursiveFileLookup="true")
    sample = F.regexp_extract("path", "sample_id=([0-9]+)", 1).cast("bigint")
    return got.select(sample.alias("sample_id"), "chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format",
                      F.array_join("sample_values", ",").alias("gt"))


@query("vcf_header", "v_clinvar", """
select distinct replace(gene, '#', '_') as info_id from v_clinvar""")
def _(v):
    path = scratch_path(v.spark, "vcf_header")
    # Every task writes the header of the ids it has, a file each.
    ids = v("v_clinvar").select(F.translate("gene", "#", "_").alias("id")).distinct()
    ids.select(F.concat(F.lit("##INFO=<ID="), "id", F.lit(",Number=1,Type=String>")).alias("value")).write.text(path)
    return OK.unnest(R.vcf_header(v.spark, path), [], F.col("info_ids"), "info_id").distinct()


@query("sam_contigs", "v_rsmap", "select chrom as name, max(pos) as length from v_rsmap group by chrom")
def _(v):
    path = scratch_path(v.spark, "sam_header")
    tops = v("v_rsmap").groupBy("chrom").agg(F.max("pos").alias("pos"))
    tops.select(F.concat(F.lit("@SQ\tSN:"), "chrom", F.lit("\tLN:"), F.col("pos").cast("string")).alias("value")).write.text(path)
    return R.sam_contigs(v.spark, path).drop("path")


@query("quarantine_short_rows", "v_calls", """
select count(*) filter (where line_no % 3 = 0) as short_rows, count(*) filter (where line_no % 3 <> 0) as rows from v_calls""")
def _(v):
    path = scratch_path(v.spark, "short_rows")
    head = "# This data file generated by 23andMe\n# rsid\tchromosome\tposition\tgenotype\n"
    row = F.when(F.col("line_no") % 3 == 0, F.concat_ws("\t", "rsid", "chrom")).otherwise(
        F.concat_ws("\t", "rsid", "chrom", F.col("pos").cast("string"), "genotype"))
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # each part file carries the header lines
    v.calls.select(F.when(first, F.concat(F.lit(head), row)).otherwise(row).alias("value")).write.text(path)
    return R.short_rows(v.spark, path).agg(F.sum("short_rows").alias("short_rows"), F.sum("rows").alias("rows"))


@query("read_id_list", "v_requests", "select rsid, count(*) as n from v_requests group by rsid")
def _(v):
    path = scratch_path(v.spark, "ids")
    v("v_requests").select(F.concat(F.lit(" "), "rsid", F.lit(" # asked")).alias("value")).write.text(path)
    return R.read_id_list(v.spark, path).groupBy("rsid").agg(F.count(F.lit(1)).alias("n"))


@query("read_specs", "v_docs", """
select cast(doc_id as varchar) as doc_id, case when doc_id % 3 = 0 then 'missing title,missing provenance' else 'missing provenance' end as reasons from v_docs""")
def _(v):
    path = scratch_path(v.spark, "specs")
    spec = F.struct(F.col("doc").cast("string").alias("doc_id"), F.when(F.col("doc") % 3 != 0, F.lit("t")).alias("title"),
                    F.lit("g").alias("group"))
    body = v.docs.select(F.to_json(spec).alias("j")).groupBy(F.spark_partition_id()).agg(F.collect_list("j").alias("j"))
    body.select(F.concat(F.lit("["), F.array_join("j", ","), F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return R.read_specs(v.spark, path).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


# Two files of one table whose columns are in another order, each under its own header.
@query("mixed_headers", "v_clinvar", """
select rsid, gene, vcv from v_clinvar union all select 'x' || rsid, gene, vcv from v_clinvar""")
def _(v):
    path = scratch_path(v.spark, "mixed")
    c = v("v_clinvar").select("rsid", "gene", "vcv")
    W.write_table(c, path + "/a")
    W.write_table(c.select("vcv", "gene", F.concat(F.lit("x"), "rsid").alias("rsid")), path + "/b")
    return R.read_table(v.spark, [path + "/a", path + "/b"], ("rsid", "gene", "vcv")).drop("line_no")


@query("enforce_header", "v_clinvar", "select rsid, gene, vcv from v_clinvar")
def _(v):
    path = scratch_path(v.spark, "exact")
    W.write_table(v("v_clinvar").select("rsid", "gene", "vcv"), path)
    return R.read_table(v.spark, path, ("rsid", "gene", "vcv"), exact=True).drop("line_no")


@query("write_claims", "v_docs v_calls", """
select doc, lineno, disposition, array_to_string(supporting, ',') as supporting_rsids, array_to_string(absent, ',') as rsids_absent,
  case when has_citation then 'y' else 'n' end as has_citation, array_to_string(tokens, ',') as blacklist_tokens, replace(text, chr(9), ' ') as text from d_claims""", AUDIT)
def _(v):
    path = scratch_path(v.spark, "claims")
    W.write_claims(jobs.audit_claims(v.docs, v.index)["claims"], path)
    columns = ("disposition", "supporting_rsids", "rsids_absent", "has_citation", "blacklist_tokens", "text")
    got = R.read_table(v.spark, path, ("doc", "lineno", *columns)).select(
        F.col("doc").cast("bigint").alias("doc"), F.col("lineno").cast("bigint").alias("lineno"), *columns)
    # Ids stand in text order; the SQL has them sorted.
    return got.withColumns({c: F.array_join(F.array_sort(F.split(c, ",")), ",") for c in ("supporting_rsids", "rsids_absent")})


# All ten columns as written, and their order. Ids stand in text order; the SQL has them sorted.
@query("write_claims_rows", "v_docs v_calls", """
select doc, lineno, disposition, array_to_string(supporting, ',') as supporting_rsids, array_to_string(absent, ',') as rsids_absent,
  case when has_citation then 'y' else 'n' end as has_citation, array_to_string(tokens, ',') as blacklist_tokens, '' as project_terms,
  case when genotype_mismatch then 'y' when not genotype_mismatch then 'n' else '' end as genotype_mismatch, replace(text, chr(9), ' ') as text,
  row_number() over (order by doc, lineno) as written from d_claims""", AUDIT)
def _(v):
    path = scratch_path(v.spark, "claims")
    W.write_claims(jobs.audit_claims(v.docs, v.index)["claims"], path)
    columns = ("disposition", "supporting_rsids", "rsids_absent", "has_citation", "blacklist_tokens", "project_terms", "genotype_mismatch", "text")
    got = _written_order(v.spark.read.csv(path, sep="\t", header=True, quote=W.NO_QUOTE, escape=""), "doc", "lineno", *columns)
    sorted_ids = {c: F.array_join(F.array_sort(F.split(c, ",")), ",") for c in ("supporting_rsids", "rsids_absent")}
    return got.fillna("", list(columns)).withColumns(
        {"doc": F.col("doc").cast("bigint"), "lineno": F.col("lineno").cast("bigint"), **sorted_ids})


@query("write_candidates", "v_docs v_rsmap v_ledger v_calls v_clinvar v_cpic", """
select rsid, chrom as chromosome, cast(pos as varchar) as position, genotype, 'y' as found, 'phase6_discovery' as source_docs, '6' as discovered_in_phase from cand""", KNOWN)
def _(v):
    path = scratch_path(v.spark, "candidates")
    W.write_candidates(_discover(v)["candidates"], path)
    return R.read_table(v.spark, path, ("rsid", "chromosome", "position", "genotype", "found", "source_docs", "discovered_in_phase")).drop("line_no")


# --- documents and lists that go through files -------------------------------------------

def _docs(v, **names):
    """The folder of all documents, one file each; ``names`` may give the expression of a file's name."""
    path = scratch_path(v.spark, "docs")
    name = names.get("name", F.concat(F.lit("d"), (F.col("doc") % 7).cast("string"), F.lit("/"), F.col("doc").cast("string")))
    W.write_docs(v.docs.select(name.alias("doc"), "text"), path)
    return path


@query("read_docs", "v_docs", """
select doc_id, 'd' || doc_id % 7 || '/' || doc_id || '.md' as doc, doc_id || '.md' as name, text from v_docs""")
def _(v):
    got = R.read_docs(v.spark, _docs(v))
    return got.select(F.regexp_extract("name", "^([0-9]+)", 1).cast("bigint").alias("doc_id"), "doc", "name", "text")


@query("file_fingerprint", "v_docs", "select doc_id, sha256(text) as sha256 from v_docs")
def _(v):
    got = W.file_fingerprint(v.spark, _docs(v), recursiveFileLookup="true")
    return got.select(F.regexp_extract("path", "([0-9]+)[.]md$", 1).cast("bigint").alias("doc_id"), "sha256")


@query("project_context", "v_docs", r"""
select doc_id, case when doc_id % 2 = 0 then 'first ' || doc_id || chr(10) || '### Later' || chr(10) || 'more' else '' end as timeline from v_docs""")
def _(v):
    n = F.col("doc").cast("string")
    head = F.when(F.col("doc") % 2 == 0, F.lit("Project Timeline")).otherwise(F.lit("Project Scope"))
    text = F.concat(F.lit("intro\n## Other\nx\n## "), head, F.lit("\nfirst "), n, F.lit("\n### Later\nmore\n## Last\ny"))
    got = OD.project_context(v.docs.select("doc", text.alias("text")))
    return got.select(F.col("doc").alias("doc_id"), F.btrim("timeline", F.lit("\n")).alias("timeline"))


@query("read_allowlist", "", """
select 'k' || n_nationkey as source_key, 'https://' || lower(r_name) || '/{id}' as url_template, 'https://' || lower(r_name) || '/' as url_root, n_name as ext
from nation join region on n_regionkey = r_regionkey""")
def _(v):
    path = scratch_path(v.spark, "allowlist")
    both = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    root = F.concat(F.lit("https://"), F.lower("r_name"), F.lit("/"))
    entry = F.struct(F.concat(root, F.lit("{id}")).alias("url_template"), root.alias("url_root"), F.col("n_name").alias("ext"))
    keyed = both.select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("k"), entry.alias("e"))
    note = keyed.select(F.concat(F.lit("_"), "k").alias("k"), "e")  # keys that begin with _ are comments
    registry = keyed.unionByName(note).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "e")))).alias("value"))
    registry.write.text(path)
    return R.read_allowlist(v.spark, path)


@query("read_phrases", "v_docs", """
select lower(substr(r_name, 1, 2)) as phrase, (select count(*) from v_docs where contains(text, lower(substr(r_name, 1, 2)))) as n_docs from region""")
def _(v):
    path = scratch_path(v.spark, "phrases")
    lines = F.concat(F.lit("# "), "r_name", F.lit("\n\n  "), F.lower(F.substring("r_name", 1, 2)), F.lit("  "))
    v.table("region").select(lines.alias("value")).write.text(path)
    found = [F.struct(F.lit(p).alias("phrase"), F.count_if(F.col("text").contains(p)).alias("n_docs"))
             for p in R.read_phrases(v.spark, path)]
    return v.docs.agg(F.array(*found).alias("f")).select(F.inline("f"))


@query("export_summary", "v_calls", """
select sample_id, '23andme' as vendor, 'GRCh37' as build, count(*) as snp_count, count(*) filter (where trim(genotype) in ('', '-', '--', '0', '00', '0 0')) as no_calls,
  count(*) filter (where trim(genotype) in ('', '-', '--', '0', '00', '0 0')) / count(*) as no_call_rate from v_calls group by sample_id""")
def _(v):
    got = jobs.export_summary(v.spark, _export(v, "23andme"), recursiveFileLookup="true")
    sample = F.regexp_extract("path", "sample_id=([0-9]+)", 1).cast("bigint")
    return got.select(sample.alias("sample_id"), "vendor", "build", "snp_count", "no_calls", "no_call_rate")


@query("vcf_summary", "v_variants", """
select chrom, 'one,two' as samples, count(*) as variant_count, count(*) filter (where filter = 'PASS' or filter = '.') as pass_count from v_variants group by chrom""")
def _(v):
    path = scratch_path(v.spark, "vcf_samples")
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone\ttwo"
    x = v("v_variants").repartition("chrom").sortWithinPartitions("chrom")
    row = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", F.lit("."), "filter", F.lit("."), F.lit("GT"), F.lit("0/1"), F.lit("."))
    # Each chromosome's file begins with the header lines.
    order = F.lag("chrom").over(Window.partitionBy("chrom").orderBy("row_id")).isNull()
    x.select("chrom", F.when(order, F.concat(F.lit(head + "\n"), row)).otherwise(row).alias("value")).write.partitionBy("chrom").text(path)
    got = jobs.vcf_summary(v.spark, path)
    chrom = F.regexp_extract("path", "chrom=([^/]+)", 1)
    return got.select(chrom.alias("chrom"), F.array_join("samples", ",").alias("samples"), "variant_count", "pass_count")


@query("qc_report_tables", "v_reads", """
select 'gc' as name, count(*) as n_rows, sum(n_reads)::bigint as n from (
  select least(floor(round(100.0 * (length(seq) - length(translate(seq, 'GC', ''))) / length(seq), 2) * 40 / 100), 39) as bin, count(*) as n_reads from v_reads where length(seq) > 0 group by 1)
union all select 'totals', 1, count(*) from v_reads where length(seq) > 0
union all select 'per_base_quality', (select max(length(qual)) from v_reads), (select sum(length(qual))::bigint from v_reads)
union all select 'overrepresented', least(20, count(*)), null from (select seq from v_reads where length(seq) > 0 group by seq)""")
def _(v):
    tables = jobs.qc_report_tables(v.reads)
    counted = {"gc": F.sum("n_reads"), "totals": F.sum("reads"), "per_base_quality": F.sum("n_reads"), "overrepresented": F.lit(None).cast("bigint")}
    parts = [tables[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), n.alias("n")) for name, n in counted.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("variant_report_tables", "v_variants", """
select 'by_chromosome' as name, count(distinct chrom) as n_rows from v_variants
union all select 'summary', 6
union all select 'filtered_out', count(*) filter (where filter not in ('PASS', '.')) from v_variants""")
def _(v):
    tables = jobs.variant_report_tables(v("v_variants"))
    parts = [tables[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"))
             for name in ("by_chromosome", "summary", "filtered_out")]
    return reduce(lambda a, b: a.unionByName(b), parts)
