"""Registered queries over calls, variants, intervals, reads and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import (
    LAST, LAST_SAMPLE, OC, OI, OK, OS, OV, XG, XS, XV, query, jobs, spread,
)

BIG = "bigint"

# --- calls -------------------------------------------------------------------


@query("last_wins", "v_calls", "select * from c_last", LAST_SAMPLE)
def _(v):
    return OK.last_wins(v.calls, ["sample_id", "rsid"]).drop("line_no")


@query("lookup_calls", "v_calls v_requests", """
select r.sample_id, req_no, r.rsid, coalesce(chrom, '') as chrom, coalesce(cast(pos as varchar), '') as pos, coalesce(genotype, 'not_tested') as genotype
from v_requests r left join c_last using (sample_id, rsid)""", LAST_SAMPLE)
def _(v):
    return OC.lookup_calls(v("v_requests"), v.calls, ["sample_id", "rsid"])


@query("lookup_id_list", "v_calls", """
select s.sample_id, cast(q.req_no as bigint) as req_no, q.rsid, coalesce(chrom, '') as chrom, coalesce(cast(pos as varchar), '') as pos, coalesce(genotype, 'not_tested') as genotype
from (select distinct sample_id from v_calls) s cross join (values (1, 'rs7'), (2, 'rs11'), (3, 'rs7'), (4, 'rsX1')) q(req_no, rsid)
left join c_last using (sample_id, rsid)""", LAST_SAMPLE)
def _(v):
    asked = OC.requests_per_sample(v.calls.select("sample_id").distinct(), ["rs7", "rs11", "rs7", "rsX1"])
    return OC.lookup_calls(asked, v.calls, ["sample_id", "rsid"])


@query("project_columns", "v_calls", "select genotype, rsid from v_calls")
def _(v):
    return OC.project_columns(v.calls, ["genotype", "rsid"])


@query("slice_calls", "v_calls", "select * from v_calls where chrom = '3' and pos between 24000 and 1500000")
def _(v):
    return OC.slice_calls(v.calls, *OC.parse_region("3:24000-1500000"))


@query("parse_region", "v_features", r"""
with f as (select feature_id, concat(chrom, ':', cast(start0 as varchar), case when feature_id % 5 = 0 then '..' else '-' end, cast(end0 as varchar)) as region from v_features)
select feature_id, region, case when valid then regexp_extract(region, '^([^:]+):', 1) end as chrom, case when valid then cast(regexp_extract(region, ':([0-9]+)-', 1) as bigint) end as start1,
  case when valid then cast(regexp_extract(region, '-([0-9]+)$', 1) as bigint) end as end1, valid
from (select *, regexp_full_match(region, '[^:]+:[0-9]+-[0-9]+') as valid from f)""".replace("with f as", "select * from (with f as") + ")")
def _(v):
    f = v("v_features")
    sep = F.when(F.col("feature_id") % 5 == 0, "..").otherwise("-")
    region = F.concat("chrom", F.lit(":"), F.col("start0").cast("string"), sep, F.col("end0").cast("string"))
    return OC.parse_regions(f.select("feature_id", region.alias("region")))


SITES = """
j as (select c.sample_id, c.line_no, c.rsid, c.genotype, m.chrom, m.pos, m.ref, m.alt, upper(trim(c.genotype)) in ('--', '00', '') as nc
  from v_calls c left join v_rsmap m using (rsid))"""


@query("calls_to_vcf", "v_calls v_rsmap", """
select sample_id, line_no, chrom, pos, rsid as id, ref, alt, '.' as qual, 'PASS' as filter, '.' as info, 'GT' as format,
  concat(case substr(genotype, 1, 1) when ref then '0' when alt then '1' else '.' end, '/', case substr(genotype, 2, 1) when ref then '0' when alt then '1' else '.' end) as gt
from j where ref is not null and not nc""", SITES)
def _(v):
    return OC.calls_to_vcf(spread(v.calls), v("v_rsmap"))


@query("conversion_accounting", "v_calls v_rsmap", """
select sample_id, count(*) filter (where ref is not null and not nc) as emitted, count(*) filter (where ref is null) as unmapped,
  count(*) filter (where ref is not null and nc) as no_call_skipped from j group by sample_id""", SITES)
def _(v):
    return OC.conversion_accounting(v.calls, v("v_rsmap"))


@query("calls_summary", "v_calls", """
select sample_id, count(*) as snp_count, count(*) filter (where trim(genotype) in ('', '-', '--', '0', '00', '0 0')) as no_calls,
  count(*) filter (where trim(genotype) in ('', '-', '--', '0', '00', '0 0')) / count(*) as no_call_rate from v_calls group by sample_id""")
def _(v):
    return OC.calls_summary(v.calls)


@query("calls_by_chrom", "v_calls", "select sample_id, chrom, count(*) as n_calls from v_calls group by all")
def _(v):
    return OC.calls_by_chrom(v.calls)


@query("norm_genotype", "v_calls", """
select line_no, case when regexp_full_match(genotype, '[ACGT]{2}') then concat(least(genotype[1], genotype[2]), greatest(genotype[1], genotype[2])) else genotype end as norm from v_calls""")
def _(v):
    return v.calls.select("line_no", XG.norm_genotype(F.col("genotype")).alias("norm"))


@query("table_fingerprint", "v_calls", """
select sample_id, n as n_rows, sha256(concat_ws(':', cast(n as varchar), cast(s0 as varchar), cast(s1 as varchar), cast(s2 as varchar), cast(s3 as varchar))) as fingerprint
from (select sample_id, count(*) as n, sum(cast('0x' || substr(h, 1, 15) as bigint)) as s0, sum(cast('0x' || substr(h, 16, 15) as bigint)) as s1,
  sum(cast('0x' || substr(h, 31, 15) as bigint)) as s2, sum(cast('0x' || substr(h, 46, 15) as bigint)) as s3
  from (select sample_id, sha256(concat_ws('|', length(rsid) || ':' || rsid, length(chrom) || ':' || chrom, length(cast(pos as varchar)) || ':' || pos,
    length(genotype) || ':' || genotype, length(cast(line_no as varchar)) || ':' || line_no)) as h from v_calls) group by sample_id)""")
def _(v):
    return OK.table_fingerprint(spread(v.calls), ["sample_id"])


# --- variants ----------------------------------------------------------------

VC = """
vc as (select *, case when alt = '.' then '' else split_part(alt, ',', 1) end as fa, filter in ('PASS', '.') as ok from v_variants),
vk as (select *, case when alt = '.' then 'other' when svtype is not null then 'sv' when length(ref) = 1 and regexp_full_match(fa, '[A-Za-z]') then 'snv'
    when length(ref) = length(fa) and length(ref) > 1 then 'mnp' else 'indel' end as k1,
  case when svtype is not null then 'sv' when length(ref) = 1 and length(fa) = 1 then 'snv' when length(ref) = length(fa) then 'mnp' else 'indel' end as k2 from vc)"""


@query("variant_class", "v_variants", "select row_id, k1 as variant_class, k2 as report_class, ok as is_pass from vk", VC)
def _(v):
    return OV.classify(v("v_variants")).select("row_id", "variant_class", "report_class", "is_pass")


@query("variant_summary", "v_variants", """
select *, case when transversions > 0 then transitions / transversions end as ts_tv_ratio from (
select chrom, count(*) as variant_count, count(*) filter (where k1 = 'snv') as snv, count(*) filter (where k1 = 'indel') as indel, count(*) filter (where k1 = 'mnp') as mnp,
  count(*) filter (where k1 = 'sv') as sv, count(*) filter (where k1 = 'snv' and ref || fa in ('AG', 'GA', 'CT', 'TC')) as transitions,
  count(*) filter (where k1 = 'snv' and ref <> fa and ref || fa not in ('AG', 'GA', 'CT', 'TC')) as transversions,
  count(*) filter (where ok) as pass_count, count(*) filter (where not ok) as filtered_count from vk group by chrom)""", VC)
def _(v):
    return OV.variant_summary(v("v_variants"), ["chrom"])


@query("ts_tv_ratio", "v_variants", """
select transitions, transversions, case when transversions > 0 then transitions / transversions end as ts_tv_ratio from (
select count(*) filter (where k1 = 'snv' and ref || fa in ('AG', 'GA', 'CT', 'TC')) as transitions,
  count(*) filter (where k1 = 'snv' and ref <> fa and ref || fa not in ('AG', 'GA', 'CT', 'TC')) as transversions from vk)""", VC)
def _(v):
    return OV.variant_summary(v("v_variants")).select("transitions", "transversions", "ts_tv_ratio")


@query("variants_by_chrom", "v_variants", "select chrom, count(*) as n_variants from v_variants group by chrom")
def _(v):
    return OV.variants_by_chrom(v("v_variants"))


@query("variant_report_counts", "v_variants", """
select k2 as metric, count(*) as value from vk group by k2 union all select case when ok then 'pass' else 'filtered' end, count(*) from vk group by 1""", VC)
def _(v):
    return OV.variant_report_counts(v("v_variants"))


@query("top_quality", "v_variants", """
select coalesce(qual, 0.0) as qual, chrom, pos, id, ref, fa as alt from vc order by 1 desc, 2 desc, 3 desc, 4 desc, 5 desc, 6 desc limit 100""", VC)
def _(v):
    return OV.top_quality(v("v_variants"))


@query("top_quality_by_chrom", "v_variants", """
select * from (select chrom, coalesce(qual, 0.0) as qual, pos, id, ref, fa as alt,
  row_number() over (partition by chrom order by coalesce(qual, 0.0) desc, pos desc, id desc, ref desc, fa desc) as rank from vc) where rank <= 100""", VC)
def _(v):
    return OV.top_quality(v("v_variants").withColumn("c", F.col("chrom")), groups=["c"]).drop("c").withColumn("rank", F.col("rank").cast(BIG))


@query("frameshift_candidates", "v_variants", """
select chrom, pos, id, ref, fa as alt from vc where length(ref) > 0 and length(fa) > 0 and abs(length(ref) - length(fa)) % 3 <> 0""", VC)
def _(v):
    return OV.frameshift_candidates(v("v_variants"))


@query("is_frameshift", "v_variants", """
select row_id, length(ref) > 0 and length(fa) > 0 and abs(length(ref) - length(fa)) % 3 <> 0 as frameshift from vc""", VC)
def _(v):
    return v("v_variants").select("row_id", XV.is_frameshift(F.col("ref"), F.col("alt")).alias("frameshift"))


@query("filtered_out", "v_variants", "select chrom, pos, id, ref, fa as alt, filter from vc where not ok", VC)
def _(v):
    return OV.filtered_out(v("v_variants"))


@query("slice_variants", "v_variants", """
select * from v_variants where chrom = 'chr5' and pos <= 900000 and pos + length(ref) - 1 >= 26002""")
def _(v):
    return OV.slice_variants(v("v_variants"), "chr5", 26002, 900000)


@query("snv_first_alt", "v_variants", """
select * replace (split_part(alt, ',', 1) as alt) from v_variants where length(ref) = 1 and length(split_part(alt, ',', 1)) = 1""")
def _(v):
    return OV.snv_first_alt(v("v_variants"))


@query("chip_sites", "v_variants v_rsmap", """
select id as rsid, chrom, pos, ref, split_part(alt, ',', 1) as alt from v_variants
where length(ref) = 1 and length(split_part(alt, ',', 1)) = 1 and id in (select rsid from v_rsmap)""")
def _(v):
    return OV.chip_sites(v("v_variants"), v("v_rsmap"))


@query("build_site_map", "v_variants v_rsmap", """
select w as written, s as chip_size, w * 100.0 / s as coverage_pct from
(select count(*) as w from v_variants where length(ref) = 1 and length(split_part(alt, ',', 1)) = 1 and id in (select rsid from v_rsmap)),
(select count(distinct rsid) as s from v_rsmap)""")
def _(v):
    return jobs.build_site_map([v("v_rsmap")], v("v_variants"))["coverage"]


@query("chip_union", "v_calls v_rsmap", "select rsid from v_calls union select rsid from v_rsmap")
def _(v):
    return OV.chip_union(v.calls, v("v_rsmap"))


# --- intervals ----------------------------------------------------------------

@query("slice_bed", "v_features", "select * from v_features where chrom = 'chr4' and start0 < 90000 and end0 > 30001 - 1")
def _(v):
    return OI.slice_bed(v("v_features"), "chr4", 30001, 90000)


@query("slice_gff", "v_features", """
select chrom, source, feature_type, start0 + 1 as start1, end0 as end1, '.' as score, strand, attributes, feature_id from v_features
where chrom = 'chr4' and start0 + 1 <= 90000 and end0 >= 30001""")
def _(v):
    return OI.slice_gff(v.gff, "chr4", 30001, 90000)


@query("bed_to_gff", "v_features", """
select chrom as seqid, 'bed2gff' as source, 'region' as feature_type, start0 + 1 as start1, end0 as end1, '.' as score, strand, '.' as phase,
  'ID=' || case when feature_id % 3 = 0 then 'region_' || feature_id else 'n' || feature_id end as attributes from v_features""")
def _(v):
    name = F.when(F.col("feature_id") % 3 != 0, F.concat(F.lit("n"), F.col("feature_id").cast("string")))
    bed = v("v_features").select(
        "chrom", "start0", "end0", name.alias("name"), F.lit(None).cast("string").alias("score"), "strand",
        F.col("feature_id").alias("line_no"),
    )
    return OI.bed_to_gff(bed)


@query("gff_to_bed", "v_features", """
select chrom, start0, end0, 'f' || feature_id as name, '.' as score, strand from v_features""")
def _(v):
    return OI.gff_to_bed(v.gff)


@query("feature_summary", "v_features", "select source, feature_type, count(*) as n_features from v_features group by all")
def _(v):
    return OI.feature_summary(v("v_features"), ["source"])


@query("span_by_chrom", "v_features", """
select chrom, count(*) as n_features, cast(sum(end0 - start0) as bigint) as span from v_features group by chrom""")
def _(v):
    return OI.span_by_chrom(v("v_features"))


@query("feature_sources", "v_features", """
select chrom, 0::bigint as part_no, count(*) as n_values, string_agg(source, ',' order by source) as sources
from (select distinct chrom, source from v_features) group by chrom""")
def _(v):
    return OI.feature_sources(v("v_features"), "chrom")


@query("overlap_join", "v_calls v_features", """
select line_no, rsid, 'chr' || c.chrom as chrom, c.pos, feature_id from v_calls c join v_features f on 'chr' || c.chrom = f.chrom and c.pos - 1 < f.end0 and c.pos > f.start0""")
def _(v):
    points = v.calls.select(
        "line_no", "rsid", F.concat(F.lit("chr"), "chrom").alias("chrom"), "pos", (F.col("pos") - 1).alias("p0")
    )
    f = v("v_features").select("chrom", "start0", "end0", "feature_id")
    return OI.overlap_join(points, f, left_span=("p0", "pos")).select("line_no", "rsid", "chrom", "pos", "feature_id")


@query("overlap_join_intervals", "v_variants v_features", """
select row_id, feature_id from v_variants c join v_features f on c.chrom = f.chrom and c.pos - 1 < f.end0 and c.pos - 1 + length(c.ref) > f.start0""")
def _(v):
    left = v("v_variants").select(
        "row_id", "chrom", (F.col("pos") - 1).alias("v0"), (F.col("pos") - 1 + F.length("ref")).alias("v1")
    )
    f = v("v_features").select("chrom", "start0", "end0", "feature_id")
    return OI.overlap_join(left, f, left_span=("v0", "v1")).select("row_id", "feature_id")


# --- reads and sequences ---------------------------------------------------------

CH = """
ch as (select read_id, length(seq) as l, unnest(generate_series(0, length(qual) - 1)) as cycle, ascii(unnest(string_split(qual, ''))) - 33 as q from v_reads)"""
LEN = """
ln as (select length(seq) as l, seq from v_reads where length(seq) > 0),
rk as (select l, sum(l) over (order by l desc rows between unbounded preceding and current row) as cum, sum(l) over () as tot from ln)"""


@query("reverse_complement", "v_reads", "select read_id, translate(reverse(seq), 'ACGT', 'TGCA') as rc from v_reads")
def _(v):
    return v("v_reads").select("read_id", XS.reverse_complement(F.col("seq")).alias("rc"))


@query("wrap_fixed", "v_reads", r"""
select read_id, rtrim(regexp_replace(seq, '(.{70})', '\1' || chr(10), 'g'), chr(10)) as wrapped from v_reads""")
def _(v):
    return v("v_reads").select("read_id", XS.wrap_fixed(F.col("seq")).alias("wrapped"))


_AA = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _translate_sql(table: str, patch: str) -> str:
    return f"""
fr as (select read_id, f as frame, substr(case when f > 0 then seq else translate(reverse(seq), 'ACGT', 'TGCA') end, abs(f)) as dna
  from v_reads, (values (1), (2), (3), (-1), (-2), (-3)) t(f)),
cd as (select read_id, frame, regexp_extract_all(dna, '.{{3}}') as cs from fr)""" + f"""
|select read_id, cast(frame as int) as frame, coalesce(list_aggregate(list_transform(cs, lambda c: case {patch} when contains(c, 'N') then 'X'
  else substr('{_AA}', 16 * (instr('TCAG', c[1]) - 1) + 4 * (instr('TCAG', c[2]) - 1) + instr('TCAG', c[3]), 1) end), 'string_agg', ''), '') as protein from cd"""


_T1 = _translate_sql("1", "").split("|")
_T5 = _translate_sql("5", "when c in ('AGA', 'AGG') then 'S' when c = 'ATA' then 'M' when c = 'TGA' then 'W'").split("|")


@query("translate_frames", "v_reads", _T1[1], _T1[0])
def _(v):
    s = v.sequences.select(F.substr("seq_id", F.lit(2)).cast(BIG).alias("read_id"), "sequence")
    return OS.translate_sequences(s)


@query("translate_chunks", "v_reads", _T1[1], _T1[0])
def _(v):
    parts = OS.translate_chunks(OS.sequence_chunks(v.sequences, 3 * 100))
    order = F.when(F.col("frame") > 0, F.col("chunk_no")).otherwise(-F.col("chunk_no"))
    whole = parts.groupBy("seq_id", "frame").agg(F.sort_array(F.collect_list(F.struct(order.alias("no"), "protein"))).alias("p"))
    return whole.select(F.substr("seq_id", F.lit(2)).cast(BIG).alias("read_id"), "frame", F.array_join("p.protein", "").alias("protein"))


@query("chunk_summary", "v_reads", """
select 'r' || read_id as seq_id, length(seq) as length, case when length(seq) = 0 then 0.0 else 100.0 * cast(length(seq) - length(translate(seq, 'GC', '')) as double) / length(seq) end as gc,
  length(seq) - length(translate(seq, 'N', '')) as ambiguous_bases from v_reads""")
def _(v):
    return OS.chunk_summary(OS.sequence_chunks(v.sequences, 3 * 100), 3 * 100).drop("path")


@query("slice_chunks", "v_reads", """
select 'r' || read_id as seq_id, 201::bigint as start1, 900::bigint as end1, substr(seq, 201, 700) as bases from v_reads where length(seq) > 200""")
def _(v):
    size = 3 * 100
    regions = v.sequences.select(F.col("seq_id").alias("chrom"), F.lit(201).cast(BIG).alias("start1"), F.lit(900).cast(BIG).alias("end1"))
    parts = OS.slice_chunks(OS.sequence_chunks(v.sequences, size), regions, size)
    whole = parts.groupBy("seq_id", "start1", "end1").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "bases"))).alias("p"))
    return whole.select("seq_id", "start1", "end1", F.array_join("p.bases", "").alias("bases")).filter("bases <> ''")


@query("genetic_code", "v_reads", _T5[1], _T5[0])
def _(v):
    s = v.sequences.select(F.substr("seq_id", F.lit(2)).cast(BIG).alias("read_id"), "sequence")
    return OS.translate_sequences(s, table_id="5")


@query("fasta_table", "v_reads", """
select 'r' || read_id as id, length(seq) as length, case when length(seq) = 0 then 0.0 else 100.0 * cast(length(seq) - length(translate(seq, 'GC', '')) as double) / length(seq) end as gc, seq as sequence from v_reads""")
def _(v):
    return OS.fasta_table(v.sequences)


@query("slice_sequences", "v_reads", """
select 'r' || read_id as seq_id, 5::bigint as start1, 12::bigint as end1, substr(seq, 5, 8) as sequence from v_reads""")
def _(v):
    regions = v("v_reads").select(
        F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("chrom"),
        F.lit(5).cast(BIG).alias("start1"), F.lit(12).cast(BIG).alias("end1"),
    )
    return OS.slice_sequences(v.sequences, regions)[0]


@query("reads_to_sequences", "v_reads", "select 'reads' as path, 'r' || read_id as header, seq as sequence from v_reads")
def _(v):
    return OS.reads_to_sequences(v.reads)


@query("fasta_summary", "v_reads", """
select 'reads' as path, count(*) as n_sequences, cast(sum(l) as bigint) as total_length, min(l) as min_length, max(l) as max_length, cast(floor(median(l)) as bigint) as median_length,
  (select max(l) from rk where cum * 2 >= tot) as n50, cast(sum(l) as double) / count(*) as mean_length,
  100.0 * cast(sum(length(seq) - length(translate(seq, 'GC', ''))) as double) / cast(sum(l) as double) as gc_percent,
  cast(sum(length(translate(seq, 'ACGTU', ''))) as bigint) as ambiguous_bases from ln""", LEN)
def _(v):
    return OS.fasta_summary(v.sequences)


@query("n50", "v_reads", "select 'reads' as path, (select max(l) from rk where cum * 2 >= tot) as n50", LEN)
def _(v):
    return OS.n50(v.sequences)


@query("fastq_summary", "v_reads", """
select 'reads' as path, count(*) as read_count, min(l) as min_length, max(l) as max_length, cast(floor(median(l)) as bigint) as median_length,
  count(*) filter (where contains(seq, 'TTAA')) as adapter_hits, count(*) as sampled_reads,
  cast(sum(l) as double) / count(*) as mean_length, 33 as phred_offset, (select cast(sum(q + 33) as double) / count(*) - 33 from ch) as mean_quality
from (select read_id, length(seq) as l, seq from v_reads where length(qual) > 0)""", CH)
def _(v):
    return OS.fastq_summary(v.reads, adapters=("TTAA",))


@query("per_base_mean_quality", "v_reads", """
select 'reads' as path, cycle, count(*) as n_reads, cast(sum(q + 33) as double) / count(*) - 33 as mean_quality from ch where cycle < l group by cycle""", CH)
def _(v):
    return OS.per_base_mean_quality(v.reads)


@query("phred_offset", "v_reads", """
select 'reads' as path, min(q) + 33 as min_code, max(q) + 33 as max_code, case when max(q) + 33 > 74 then 64 else 33 end as phred_offset, max(q) + 33 <= 74 and min(q) + 33 >= 59 as ambiguous from ch""", CH)
def _(v):
    return OS.quality_range(v.reads)


@query("adapter_hits", "v_reads", """
select 'reads' as path, count(*) filter (where contains(seq, 'TTAA') or contains(seq, 'GGCC')) as adapter_hits, count(*) as sampled_reads from v_reads""")
def _(v):
    return OS.adapter_hits(v.reads, ("TTAA", "GGCC"))


@query("head_sample", "v_reads", "select 'r' || read_id as name, seq from v_reads where read_id <= 300")
def _(v):
    return OS.head_sample(v.reads, 300).select("name", "seq")


@query("qc_per_base_box", "v_reads", """
select 'reads' as path, cycle, any_value(n) as n_reads, any_value(q1) as q1, any_value(q2) as median, any_value(q3) as q3,
  least(min(q) filter (where q >= q1 - 1.5 * (q3 - q1)), any_value(q1)) as whisker_low, greatest(max(q) filter (where q <= q3 + 1.5 * (q3 - q1)), any_value(q3)) as whisker_high
from ch join (select cycle, count(*) as n, quantile_cont(q, 0.25) as q1, quantile_cont(q, 0.5) as q2, quantile_cont(q, 0.75) as q3 from ch group by cycle) using (cycle)
group by cycle""", CH)
def _(v):
    return OS.qc_per_base_box(v.reads)


@query("qc_read_quality_hist", "v_reads", """
select 'reads' as path, cast(least(floor((m - lo) * 40 / (hi - lo)), 39) as bigint) as bin, count(*) as n_reads
from (select cast(sum(q + 33) as double) / count(*) as m from ch group by read_id), (select min(m) as lo, max(m) as hi from (select cast(sum(q + 33) as double) / count(*) as m from ch group by read_id)) group by all""", CH)
def _(v):
    return OS.qc_read_quality_hist(v.reads)


@query("qc_length_hist", "v_reads", """
select 'reads' as path, cast(least(floor(cast(length(seq) - lo as double) * 40 / cast(hi - lo as double)), 39) as bigint) as bin, count(*) as n_reads
from v_reads, (select min(length(seq)) as lo, max(length(seq)) as hi from v_reads) group by all""")
def _(v):
    return OS.qc_length_hist(v.reads)


@query("qc_gc_hist", "v_reads", """
select 'reads' as path, cast(least(floor(round(100.0 * cast(length(seq) - length(translate(seq, 'GC', '')) as double) / length(seq), 2) * 40 / 100.0), 39) as bigint) as bin, count(*) as n_reads
from v_reads where length(seq) > 0 group by all""")
def _(v):
    return OS.qc_gc_hist(v.reads)


@query("qc_n_content", "v_reads", """
select 'reads' as path, cycle, count(*) as n_reads, count(*) filter (where b = 'N') as n_count, 100.0 * cast(count(*) filter (where b = 'N') as double) / count(*) as n_pct
from (select unnest(generate_series(0, length(seq) - 1)) as cycle, unnest(string_split(seq, '')) as b from v_reads) group by cycle""")
def _(v):
    return OS.qc_n_content(v.reads)


@query("qc_totals", "v_reads", """
select 'reads' as path, count(*) as reads, cast(sum(length(seq)) as bigint) as bases, cast(sum(length(seq) - length(replace(seq, 'N', ''))) as bigint) as n_bases,
  100.0 * cast(sum(length(seq) - length(replace(seq, 'N', ''))) as double) / cast(sum(length(seq)) as double) as n_rate from v_reads where length(seq) > 0""")
def _(v):
    return OS.qc_totals(v.reads)


@query("overrepresented", "v_reads", """
select 'reads' as path, seq, count(*) as n_reads, min(read_id) as first_read, cast(row_number() over (order by count(*) desc, min(read_id)) as int) as rank
from v_reads where length(seq) > 0 group by seq order by n_reads desc, first_read limit 20""")
def _(v):
    return OS.overrepresented(v.reads)
