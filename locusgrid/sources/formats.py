"""Genomics text formats and reference tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import constants as K
from ..functions.text import strip
from ..operators.keyed import last_wins, unnest
from ..session import fixed_rows
from . import lines as L
from . import ranges


# A phrase list becomes part of expressions; a longer file isn't one.
MAX_PHRASES = 10_000


def _field(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


# --- genotype exports --------------------------------------------------------

def export_files(lines: DataFrame) -> DataFrame:
    """Per file ``path, vendor, assembly, first_data_line, first_line``, from its lines; see ``export_facts``."""
    head = L.heads(lines)
    data = ~(strip(F.col("value")) == "") & ~strip(F.col("value")).startswith("#")
    at = F.when(data, F.col("line_no"))
    first = lines.groupBy("path").agg(F.min(at).alias("first_data_line"), F.min_by("value", at).alias("first_line"))
    return head.join(first, "path").select(
        "path", L.vendor_of(F.col("head")).alias("vendor"),
        L.assembly_of(F.col("head")).alias("assembly"), "first_data_line", "first_line",
    )


def export_facts(spark: SparkSession, path, **options) -> DataFrame:
    """``export_files`` of the files at ``path`` that have content, from a bounded read of each. Files in a store that
    tasks can't open are read as lines."""
    if not ranges.opens(spark, path):
        return export_files(L.numbered_lines(spark, path, **options))
    files = L.listing(spark, path, **options).filter("length > 0")
    h = ranges.heads(files, L.SAMPLE_BYTES, L.SNIFF_BYTES, data_line=True)
    return h.select(F.col("scan_path").alias("path"), L.vendor_of(F.col("head")).alias("vendor"),
                    L.assembly_of(F.col("head")).alias("assembly"), "first_data_line", "first_line")


def parse_calls(lines: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """All rows of all layouts with ``ok``: false for data rows that are too short. With ``strict`` a row of a file
    without a known layout fails, else such files are left out. A MyHeritage file's first data line is its header
    if it begins with RSID, and so is any repetition of it.
    Columns ``path, sample_id, rsid, chrom, pos, genotype, line_no, ok``; ``pos`` is null where
    it is no whole number and ``pos_text`` keeps it as written."""
    j = lines.join(files.select("path", "vendor", "first_line"), "path")
    if not strict:
        j = j.filter(F.col("vendor").isNotNull())
    my = F.coalesce(F.col("vendor") == "myheritage", F.lit(False))
    v = F.when(my, strip(F.col("value"))).otherwise(F.col("value"))
    j = j.withColumn("_p", F.when(my, F.split(v, ",")).otherwise(F.split(v, "\t")))
    p = F.col("_p")
    first = F.coalesce(F.col("value") == F.col("first_line"), F.lit(False))
    header = F.when(my, first & (F.upper(_field(p, 0)) == "RSID")).otherwise(F.lower(_field(p, 0)) == "rsid")
    need = F.when(F.col("vendor") == "ancestrydna", 5).otherwise(4)
    rows = j.filter((v != "") & ~v.startswith("#") & ~header)
    # The test stands where both sides of the join are used, so only rows that are read can fail.
    wide = F.size(p) >= need
    unknown = F.concat(F.lit("not a recognized consumer DNA file: "), "path")
    ok = F.when(F.col("vendor").isNull() & (F.size(p) > 0), F.raise_error(unknown).cast("boolean")).otherwise(wide) if strict else wide

    def text(i):
        return F.when(my, F.btrim(_field(p, i), F.lit('"'))).otherwise(_field(p, i))

    genotype = F.when(F.col("vendor") == "ancestrydna", F.concat(_field(p, 3), _field(p, 4))).otherwise(text(3))
    return rows.select(
        "path", F.regexp_extract("path", r"([^/]+?)(\.[^/.]*)?(\.gz)?$", 1).alias("sample_id"),
        text(0).alias("rsid"), text(1).alias("chrom"), text(2).try_cast("bigint").alias("pos"),
        text(2).alias("pos_text"), genotype.alias("genotype"), "line_no", ok.alias("ok"),
    )


def _of_group(facts: DataFrame, files, path) -> DataFrame:
    """The rows of ``facts`` (path, ...) for one of ``file_groups``, small enough to be broadcast. Scans of local
    files begin their paths with one slash or three, so there is a row for each form."""
    if files is not path:
        own = facts.sparkSession.createDataFrame([(f,) for f in files], "own string").select(L.plain_path("own").alias("own"))
        facts = facts.join(own, L.plain_path(facts["path"]) == F.col("own"), "left_semi")
    plain = L.plain_path("path")
    forms = F.when(plain.startswith("/"), F.array(F.concat(F.lit("file:"), plain), F.concat(F.lit("file://"), plain))).otherwise(
        F.array("path"))
    return F.broadcast(facts.withColumn("path", F.explode(forms)))


def _parsed(spark: SparkSession, path, options: dict, strict: bool) -> DataFrame:
    facts = export_facts(spark, path, **options)

    def read(files) -> DataFrame:
        lines = L.split_lines(spark, files, **options).select("path", "value", F.struct("_block", "_id").alias("line_no"))
        return parse_calls(lines, _of_group(facts, files, path), strict)

    return L.by_group(spark, path, options, read)


def read_calls(spark: SparkSession, path, **options) -> DataFrame:
    """Genotype calls of 23andMe, AncestryDNA and MyHeritage exports; the layout is found per
    file, from its head. Short rows are left out (see ``short_rows``); files of another kind fail the read. The data
    are read once: ``line_no`` orders the rows of a file by where they stand, as (split, row)."""
    return _parsed(spark, path, options, True).filter("ok").drop("ok")


def short_rows(spark: SparkSession, path, **options) -> DataFrame:
    """Per file: data rows that were too short to use."""
    return _parsed(spark, path, options, False).groupBy("path").agg(
        F.count_if(~F.col("ok")).alias("short_rows"), F.count_if(F.col("ok")).alias("rows"))


def read_site_map(spark: SparkSession, path, **options) -> DataFrame:
    """``rsid, chrom, pos, ref, alt``; a repeated rsID takes its last row."""
    p = F.split("value", "\t")
    rows = L.numbered_lines(spark, path, **options).filter(
        (strip(F.col("value")) != "") & ~F.col("value").startswith("#") & (F.size(p) >= 5))
    sites = rows.select(
        _field(p, 0).alias("rsid"), _field(p, 1).alias("chrom"), _field(p, 2).cast("bigint").alias("pos"),
        _field(p, 3).alias("ref"), _field(p, 4).alias("alt"), F.struct("path", "line_no").alias("line_no"))
    return last_wins(sites, ["rsid"]).drop("line_no")


def first_site_map(spark: SparkSession, *candidates) -> DataFrame:
    """The first of several site-map paths that exists: override, full map, stub."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        if c:
            p = jvm.org.apache.hadoop.fs.Path(c)
            if p.getFileSystem(conf).exists(p):
                return read_site_map(spark, c)
    raise FileNotFoundError(f"no site map at any of {[c for c in candidates if c]}")


# --- sequences and reads -------------------------------------------------------

def read_fasta(spark: SparkSession, path, **options) -> DataFrame:
    """``path, record_no, seq_id, description, sequence``. Records are cut at ``>`` at the start
    of a line by the text reader, so a large file still splits; text before the first record is
    left out."""
    r = L.numbered_lines(spark, path, line_sep="\n>", **options)
    first = F.col("line_no") == 1
    r = r.filter(~first | F.col("value").startswith(">"))
    body = F.when(first, F.substr("value", F.lit(2))).otherwise(F.col("value"))
    r = r.select("path", F.col("line_no").alias("record_no"), F.replace(body, F.lit("\r"), F.lit("")).alias("_r"))
    header = F.substring_index("_r", "\n", 1)
    rest = F.when(F.contains("_r", F.lit("\n")), F.substr("_r", F.locate("\n", F.col("_r")) + 1)).otherwise(F.lit(""))
    return r.select(
        "path", "record_no", F.regexp_extract(header, r"^\s*(\S+)", 1).alias("seq_id"),
        header.alias("description"), F.replace(rest, F.lit("\n"), F.lit("")).alias("sequence"))


def read_fastq(spark: SparkSession, path, **options) -> DataFrame:
    """``path, read_no, header, name, seq, qual`` of four-line records. Reading a file ends at
    its first empty quality line; a record before it whose header has no ``@`` fails the read.

    A task joins the records that lie in its split from their consecutive lines. Only the lines of a record that
    crosses the border of splits, at most three on each side of it, are shuffled.
    """
    def read(files) -> DataFrame:
        scan = L.split_lines(spark, files, **options)
        # The first empty line of each remainder of the id by four: which of them is a quality line is known once
        # the lines before the split are.
        empty = [F.min(F.when((F.col("value") == "") & (F.col("_id") % 4 == r), F.col("_id"))).alias(f"_e{r}") for r in range(4)]
        splits = L.counted_splits(scan, *empty)
        at = F.pmod(F.col("_first") - F.col("_before") + 3, F.lit(4))
        ends = F.coalesce(*[F.when(at == r, F.col(f"_e{r}")) for r in range(4)])
        ends = F.expr("_before - _first").cast("bigint") + ends  # lines before it in the file
        whole = Window.partitionBy("path")
        splits = splits.select("path", "_block", "_first", "_n", "_before", F.min(ends).over(whole).alias("_stop"))
        lines = scan.join(F.broadcast(splits), ["path", "_block"]).select(
            "path", "_block", (F.col("_before") + F.col("_id") - F.col("_first")).alias("_no"), "_before", "_n", "_stop", "value")
        lines = lines.filter(F.col("_stop").isNull() | (F.col("_no") < F.col("_stop") - 3))
        # The first and last line numbers of the records that are whole in the split.
        low = F.expr("_before + pmod(-_before, 4)")
        high = F.expr("_before + _n - pmod(_before + _n, 4)")
        inside = (F.col("_no") >= low) & (F.col("_no") < high)
        records = lines.filter(inside).select("path", "_no", "value").mapInArrow(
            _stitched, "path string, read_no bigint, header string, seq string, qual string")
        at = F.col("_no") % 4
        across = lines.filter(~inside).groupBy("path", F.expr("_no div 4 + 1").alias("read_no")).agg(*[
            F.max(F.when(at == i, F.col("value"))).alias(n) for i, n in ((0, "header"), (1, "seq"), (3, "qual"))])
        return records.unionByName(across)

    kept = L.by_group(spark, path, options, read).filter(F.coalesce(F.col("qual"), F.lit("")) != "")
    checked = F.when(F.col("header").startswith("@"), F.col("header")).otherwise(F.raise_error(
        F.concat(F.lit("no FASTQ header: "), F.coalesce("header", F.lit("")), F.lit(" in "), "path")))
    return kept.withColumn("header", checked).select(
        "path", "read_no", "header", F.substr("header", F.lit(2)).alias("name"), "seq", "qual")


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from lines that come in order, four for each; a batch may end within a record."""
    rest = None
    for batch in batches:
        lines = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        n = lines.num_rows // 4 * 4
        rest = lines.slice(n).to_batches()[0] if lines.num_rows > n else None
        if n:
            first, value = np.arange(0, n, 4), lines.column("value")
            numbers = lines.column("_no").take(first).to_numpy() // 4 + 1
            columns = [lines.column("path").take(first), pa.array(numbers), *[value.take(first + i) for i in (0, 1, 3)]]
            yield from pa.table(columns, ["path", "read_no", "header", "seq", "qual"]).to_batches()


# --- variants and alignments -----------------------------------------------------

def read_vcf(spark: SparkSession, path, **options) -> DataFrame:
    """Data lines: the fixed columns, ``svtype`` from INFO, ``format`` and ``sample_values``."""
    p = F.split("value", "\t")
    rows = L.raw_lines(spark, path, **options).filter(
        (F.col("value") != "") & ~F.col("value").startswith("#") & (F.size(p) >= 8))
    qual = _field(p, 5)
    return rows.select(
        "path", _field(p, 0).alias("chrom"), _field(p, 1).cast("bigint").alias("pos"),
        F.when(_field(p, 2) != ".", _field(p, 2)).alias("id"), _field(p, 3).alias("ref"),
        _field(p, 4).alias("alt"), F.when(qual != ".", qual.try_cast("double")).alias("qual"),
        _field(p, 6).alias("filter"), _field(p, 7).alias("info"),
        F.nullif(F.regexp_extract(_field(p, 7), "(?:^|;)SVTYPE=([^;]*)", 1), F.lit("")).alias("svtype"),
        _field(p, 8).alias("format"), F.slice(p, F.lit(10), F.greatest(F.size(p) - 9, F.lit(0))).alias("sample_values"))


def vcf_header(spark: SparkSession, path, **options) -> DataFrame:
    """Per file the sorted distinct ``info_ids`` and ``format_ids`` and the ``samples`` in order."""
    v = F.col("value")
    h = L.raw_lines(spark, path, **options).filter(v.startswith("#"))
    ident = F.regexp_extract(v, r"^##(?:INFO|FORMAT)=<(?:[^>]*?,)?ID=([^,>]+)", 1)

    def ids(prefix):
        return F.sort_array(F.collect_set(F.when(v.startswith(prefix) & (ident != ""), ident)))

    cols = F.split(v, "\t")
    named = F.slice(cols, F.lit(10), F.greatest(F.size(cols) - 9, F.lit(0)))
    return h.groupBy("path").agg(
        ids("##INFO=<").alias("info_ids"), ids("##FORMAT=<").alias("format_ids"),
        F.coalesce(F.max(F.when(v.startswith("#CHROM"), named)), F.array().cast("array<string>")).alias("samples"))


def read_sam(spark: SparkSession, path, **options) -> DataFrame:
    p = F.split("value", "\t")
    rows = L.raw_lines(spark, path, **options).filter(~F.col("value").startswith("@") & (F.size(p) >= 11))
    return rows.select(
        "path", _field(p, 0).alias("qname"), _field(p, 1).cast("int").alias("flag"), _field(p, 2).alias("rname"),
        _field(p, 3).cast("bigint").alias("pos"), _field(p, 4).cast("int").alias("mapq"),
        _field(p, 5).alias("cigar"), _field(p, 9).alias("seq"), _field(p, 10).alias("qual"))


def sam_contigs(spark: SparkSession, path, **options) -> DataFrame:
    v = F.col("value")
    rows = L.raw_lines(spark, path, **options).filter(v.startswith("@SQ"))
    return rows.select("path", F.regexp_extract(v, r"\tSN:([^\t]+)", 1).alias("name"),
                       F.regexp_extract(v, r"\tLN:([0-9]+)", 1).cast("bigint").alias("length"))


# --- intervals ---------------------------------------------------------------------

def read_bed(spark: SparkSession, path, **options) -> DataFrame:
    """``path, line_no, chrom, start0, end0, name, score, strand``; the last three may be null."""
    v, p = F.col("value"), F.split("value", "\t")
    rows = L.numbered_lines(spark, path, **options).filter(
        (strip(v) != "") & ~v.startswith("#") & ~v.startswith("track") & (F.size(p) >= 3))
    return rows.select(
        "path", "line_no", _field(p, 0).alias("chrom"), _field(p, 1).cast("bigint").alias("start0"),
        _field(p, 2).cast("bigint").alias("end0"), _field(p, 3).alias("name"), _field(p, 4).alias("score"),
        _field(p, 5).alias("strand"))


def read_gff(spark: SparkSession, path, **options) -> DataFrame:
    """GFF3 or GTF rows with both coordinate forms."""
    v, p = F.col("value"), F.split("value", "\t")
    rows = L.raw_lines(spark, path, **options).filter(
        (strip(v) != "") & ~v.startswith("#") & ~v.startswith("track") & (F.size(p) >= 9))
    start1 = _field(p, 3).cast("bigint")
    end1 = _field(p, 4).cast("bigint")
    return rows.select(
        "path", _field(p, 0).alias("chrom"), _field(p, 1).alias("source"), _field(p, 2).alias("feature_type"),
        start1.alias("start1"), end1.alias("end1"), (start1 - 1).alias("start0"), end1.alias("end0"),
        _field(p, 5).alias("score"), _field(p, 6).alias("strand"), _field(p, 7).alias("phase"),
        _field(p, 8).alias("attributes"))


# --- chip manifests and site lists ---------------------------------------------------

def read_chip_manifest(spark: SparkSession, path, **options) -> DataFrame:
    """``path, rsid``: distinct ``rs`` names of the ``[Assay]`` section. Sections are found from
    the few bracketed lines of a file, so its rows stay where they were read."""
    return L.by_group(spark, path, options, lambda files: _assay_names(spark, files, options)).distinct()


def _assay_names(spark: SparkSession, path, options: dict) -> DataFrame:
    lines = L.numbered_lines(spark, path, **options).withColumn("value", strip(F.col("value")))
    marks = lines.filter(F.col("value").startswith("[") & F.col("value").endswith("]"))
    start = marks.filter(F.col("value") == "[Assay]").groupBy("path").agg(F.min("line_no").alias("_from"))
    end = marks.filter(F.col("value") != "[Assay]").join(start, "path").filter(
        F.col("line_no") > F.col("_from")).groupBy("path").agg(F.min("line_no").alias("_to"))
    span = start.join(end, "path", "left")
    body = lines.join(F.broadcast(span), "path").filter(
        (F.col("line_no") > F.col("_from")) & (F.col("_to").isNull() | (F.col("line_no") < F.col("_to")))
        & (F.col("value") != "[Assay]"))
    names = F.transform(F.split("value", ","), lambda c: F.lower(strip(c)))
    head = body.withColumn("_at", F.array_position(names, "name")).filter(F.col("_at") > 0).groupBy("path").agg(
        F.min(F.struct("line_no", "_at")).alias("_h"))
    rows = body.join(F.broadcast(head), "path").filter(F.col("line_no") > F.col("_h.line_no"))
    name = strip(F.get(F.split("value", ","), F.col("_h._at").cast("int") - 1))
    return rows.select("path", name.alias("rsid")).filter(F.col("rsid").startswith("rs"))


def read_dbsnp_sites(spark: SparkSession, path, **options) -> DataFrame:
    p = F.split("value", "\t", 8)
    rows = L.raw_lines(spark, path, **options).filter(~F.col("value").startswith("#") & (F.size(p) >= 5))
    return rows.select(_field(p, 0).alias("chrom"), _field(p, 1).cast("bigint").alias("pos"),
                       _field(p, 2).alias("id"), _field(p, 3).alias("ref"), _field(p, 4).alias("alt"))


# --- documents and tables by header ----------------------------------------------------

def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """``doc, name, text`` of every ``*.md`` below a folder, empty and hidden ones too; ``doc`` is the
    path below it. Tasks read the files that they have listed, so the driver holds no list of them. In a store that tasks
    can't open Spark's reader does."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.md"}
    files = L.listing(spark, path, **options)
    found = files.filter("length = 0").select(F.col("path").alias("full"), F.lit("").alias("value"))
    filled = files.filter("length > 0")
    if ranges.opens(spark, path):
        found = found.unionByName(ranges.texts(filled).select(F.col("path").alias("full"), F.col("content").cast("string").alias("value")))
    else:
        if not filled.isEmpty():
            encoded = F.replace(L.plain_path("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
            read = spark.read.options(**options).text(path, wholetext=True)
            found = found.unionByName(read.select(F.url_decode(encoded).alias("full"), "value"))
        hidden = L.hidden_files(files).select(F.col("path").alias("full"), F.decode("content", "utf-8").alias("value"))
        found = found.unionByName(hidden)
    root, full = path.rstrip("/").removeprefix("file://") + "/", F.col("full")
    return found.select(
        F.when(full.contains(root), F.substr(full, F.locate(root, full) + len(root))).otherwise(full).alias("doc"),
        F.substring_index(full, "/", -1).alias("name"), F.col("value").alias("text"))


def read_table(spark: SparkSession, path, required, exact: bool = False) -> DataFrame:
    """A tab-separated table matched by header name, all strings. Every file of a folder has a header of
    its own, and its columns are found by that. A missing column fails; with ``exact`` any other column,
    order or width fails too. Short rows are left out otherwise. ``line_no`` orders the rows of a file."""
    required = list(required)
    if not spark.read.text(path).inputFiles() and L.listing(spark, path).isEmpty():
        raise ValueError(f"empty table: {path}")
    return L.by_group(spark, path, {}, lambda files: _table_rows(spark, files, required, exact))


def _table_rows(spark: SparkSession, path, required: list, exact: bool) -> DataFrame:
    want = F.array(*map(F.lit, required))
    scan = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"),
        "value")
    heads = scan.groupBy("path").agg(F.min("at").alias("first"), F.min_by("value", "at").alias("head"))
    heads = heads.withColumn("columns", F.split("head", "\t"))
    bad = heads.filter(F.size(F.array_except(want, "columns")) > 0) if not exact else heads.filter(F.col("columns") != want)
    wrong = bad.select("path", "columns", F.array_except(want, "columns").alias("missing")).limit(1).collect()
    if wrong and wrong[0]["missing"]:
        raise ValueError(f"missing column(s): {','.join(wrong[0]['missing'])} in {wrong[0]['path']}")
    if wrong:
        raise ValueError(f"header {list(wrong[0]['columns'])} is not {required} in {wrong[0]['path']}")
    p, width = F.col("parts"), F.size("columns")
    rows = scan.join(F.broadcast(heads.drop("head")), "path").filter(
        (F.col("at") != F.col("first")) & (strip(F.col("value")) != "")).withColumn("parts", F.split("value", "\t"))
    if exact:
        rows = rows.filter(F.when(F.size(p) != width, F.raise_error(
            F.concat(F.lit("malformed row: "), "value"))).otherwise(F.lit(True)))
    places = [F.array_position("columns", F.lit(c)).cast("int") for c in required]
    rows = rows.filter(F.size(p) >= F.greatest(*places, F.lit(1)))
    return rows.select(F.struct("path", "at").alias("line_no"),
                       *[F.get(p, at - 1).alias(c) for c, at in zip(required, places)])


def read_index(spark: SparkSession, path) -> DataFrame:
    """``rsid, genotype, found``; a repeated rsID takes its last row."""
    return last_wins(read_table(spark, path, ("rsid", "genotype", "found")), ["rsid"]).drop("line_no")


def read_clinvar(spark: SparkSession, path) -> DataFrame:
    return read_table(spark, path, ("rsid", "pathogenic_allele", "gene", "vcv", "significance")).drop("line_no")


def read_cpic(spark: SparkSession, path) -> DataFrame:
    return read_table(spark, path, ("gene", "drug", "level", "defining_rsids")).drop("line_no")


def read_phrases(spark: SparkSession, path) -> list[str]:
    """Phrase patterns, one per line; ``#`` and blank lines are comments. A short list that ends
    up inside expressions, so it is returned as such."""
    rows = L.numbered_lines(spark, path).orderBy("line_no").limit(MAX_PHRASES + 1).collect()
    if len(rows) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} lines of phrases in {path}")
    kept = (r["value"].strip() for r in rows)
    return [p for p in kept if p and not p.startswith("#")]


def read_id_list(spark: SparkSession, path) -> DataFrame:
    """Requested ids ``(req_no, rsid)`` of a file: first word per line, order and repeats kept."""
    v = strip(F.col("value"))
    rows = L.numbered_lines(spark, path).filter((v != "") & ~v.startswith("#"))
    return rows.select(F.col("line_no").alias("req_no"), F.regexp_extract(v, r"^(\S+)", 1).alias("rsid"))


def read_terms(arg: str | list[str]) -> list[str]:
    """Project terms, sorted and distinct."""
    raw = arg.split(",") if isinstance(arg, str) else arg
    return sorted({t.strip() for t in raw if t.strip() and not t.strip().startswith("#")})


def read_allowlist(spark: SparkSession, path=None) -> DataFrame:
    """Citation sources from a JSON registry (keys with ``_`` are comments) or the fixed list."""
    if path is None:
        return fixed_rows(
            spark, K.CITATION_SOURCES, "source_key string, url_template string, url_root string, ext string")
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,string>")
    entries = unnest(text, [], F.map_entries(m), "_e").filter(~F.col("_e.key").startswith("_"))
    spec = F.from_json("_e.value", "url_template string, url_root string, ext string")
    return entries.select(F.col("_e.key").alias("source_key"), spec.alias("_s")).select("source_key", "_s.*")


# --- report specifications ----------------------------------------------------------------

_S = T.StringType()


def _struct(*names, **typed):
    return T.StructType([T.StructField(n, _S) for n in names] + [T.StructField(n, t) for n, t in typed.items()])


TRIPLE = _struct("rsid", "chrom", "pos", "genotype")
CITATION = _struct("source_key", "label", "url", "access_date")
PROVENANCE = T.StructType([
    T.StructField(n, {"phase": T.IntegerType(), "external_sources_used": T.ArrayType(_S),
                      "produced_on": T.DateType(), "external_sources_access_date": T.DateType(),
                      "source_genome_line_count_verified": T.IntegerType(),
                      "removed_claims_count": T.IntegerType(), "added_claims_count": T.IntegerType()}.get(n, _S))
    for n in K.PROVENANCE_FIELDS])
DOCUMENT = _struct(
    "doc_id", "title", "group", "kicker", "subtitle", "_corrupt_record", provenance=PROVENANCE, facts=T.ArrayType(_S),
    alert_rows=T.ArrayType(_struct("drug", "gene_genotype", "evidence", "recommendation", citation=CITATION)),
    findings=T.ArrayType(_struct("gene", "name", "evidence", "implication", "subtitle", "historical_note", tier=T.IntegerType(),
                                 triples=T.ArrayType(TRIPLE), citations=T.ArrayType(CITATION))),
    genotype_rows=T.ArrayType(_struct("rsid", "chrom", "pos", "genotype", "gene", tier=T.IntegerType())))
MANIFEST = _struct(
    "subject_label", "report_id", "assembly", "array", "access_date", "source_sha256", "supersedes",
    "supersedes_sha256", "build_label", "_corrupt_record", sources=T.ArrayType(_S), groups=T.ArrayType(_S),
    stats=T.MapType(_S, _S),
    docs=T.ArrayType(_struct("doc_id", "title", "filename", "group", "number", "blurb", "tier_summary", "findings_label",
                             "search_terms", "icon_token", tier=T.IntegerType(), available=T.BooleanType())))


def read_specs(spark: SparkSession, path, schema=DOCUMENT) -> DataFrame:
    """JSON specifications as typed rows with ``reasons``: what makes a row unusable."""
    required = ("doc_id", "title", "group", "provenance") if schema is DOCUMENT else (
        "subject_label", "report_id", "assembly", "access_date")
    d = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    bad = [F.when(F.col("_corrupt_record").isNotNull(), F.lit("not readable"))]
    for c in required:
        gone = F.col(c).isNull() if c == "provenance" else F.coalesce(strip(F.col(c)), F.lit("")) == ""
        bad.append(F.when(gone, F.lit(f"missing {c}")))
    return d.withColumn("reasons", F.array_compact(F.array(*bad)))
