"""Text files as numbered lines, and facts about each file."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..operators.keyed import estimated_bytes, unnest
from . import ranges

# One small row per input split or file is broadcast, for groups of files with about this many of them (100 MB).
SPLITS_PER_GROUP = 500_000
SNIFF_BYTES = 4096
SAMPLE_BYTES = 65536
LINE_END = r"\r\n|\n|\r"


def plain_path(path) -> Column:
    """A path without the scheme that only some readers put before a local one."""
    return F.regexp_replace(path, "^file:/+", "/")


def listing(spark: SparkSession, path, recursiveFileLookup="false", pathGlobFilter=None, **_) -> DataFrame:
    """``path, length`` of all files, from the file system's own listing: empty files and those whose
    names begin with ``_`` or ``.`` are there too, which Spark's readers leave out (Hadoop's own marks,
    ``_SUCCESS`` and ``.crc``, are not). Files directly in a folder, or at any depth with ``recursiveFileLookup``; part folders (``key=value``) always count.

    Tasks list the folders. Only a store that tasks can't open is listed from the driver."""
    if ranges.opens(spark, path):
        return ranges.listing(spark, path, recursiveFileLookup, pathGlobFilter)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    deep = str(recursiveFileLookup).lower() == "true"
    rows, todo = [], []
    for p in [path] if isinstance(path, str) else path:
        hadoop = jvm.org.apache.hadoop.fs.Path(p)
        fs = hadoop.getFileSystem(conf)
        todo += [(fs, status) for status in fs.globStatus(hadoop) or []]
    while todo:
        fs, status = todo.pop()
        if status.isFile():
            if ranges.counts(status.getPath().getName(), pathGlobFilter):
                rows.append((re.sub("^file:/+", "/", status.getPath().toString()), status.getLen()))
            continue
        for inner in fs.listStatus(status.getPath()):
            if inner.isFile() or deep or "=" in inner.getPath().getName():
                todo.append((fs, inner))
    return spark.createDataFrame(rows, "path string, length bigint")


def hidden_files(files: DataFrame) -> DataFrame:
    """``path, content`` of the files with content that Spark's readers skip for their names. Tasks read them; in a
    store that tasks can't open they are refused by name."""
    name = F.substring_index("path", "/", -1)
    hidden = files.filter((F.col("length") > 0) & (name.startswith("_") | name.startswith(".")))
    first = hidden.first()
    if first and not ranges.opens(files.sparkSession, first["path"]):
        raise ValueError(f"a name that begins with _ or . can't be read in this store: {first['path']}")
    return ranges.texts(hidden)


def most_splits(lines: DataFrame) -> int:
    """An upper bound of the input splits of a text scan, from what Spark has listed for it."""
    size = lines.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    conf = lines.sparkSession.conf
    least = min(size(conf.get(f"spark.sql.files.{k}", d)) for k, d in (("openCostInBytes", "4194304"), ("maxPartitionBytes", "134217728")))
    return len(lines._jdf.inputFiles()) + estimated_bytes(lines) // max(1, least)


def file_groups(spark: SparkSession, path, **options) -> list:
    """``path`` itself, or, where its files have more splits than are broadcast at once, lists of files with
    about ``SPLITS_PER_GROUP`` each. A file is in one group whole. What a reader broadcasts for one group so has
    a bound, and lines need no shuffle however many files there are."""
    scan = spark.read.options(**options).text(path)
    if most_splits(scan) <= SPLITS_PER_GROUP:
        return [path]
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    least = size(spark.conf.get("spark.sql.files.openCostInBytes", "4194304"))
    files = spark.read.options(**options).format("binaryFile").load(path).select("path", F.expr(f"length div {least} + 1").alias("n"))
    groups, room = [], 0
    for file, n in files.toLocalIterator():
        if not groups or n > room:
            groups.append([])
            room = SPLITS_PER_GROUP
        groups[-1].append(file)
        room -= n
    return groups


def by_group(spark: SparkSession, path, options: dict, read) -> DataFrame:
    """The rows of ``read(files)`` over all ``file_groups``."""
    return reduce(DataFrame.unionByName, [read(group) for group in file_groups(spark, path, **options)])


def raw_lines(spark: SparkSession, path, line_sep: str | None = None, **options) -> DataFrame:
    """``path, value`` without numbers: one pass, no join."""
    reader = spark.read.options(**options)
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def split_lines(spark: SparkSession, path, line_sep: str | None = None, **options) -> DataFrame:
    """``path, _block, _id, value``: lines with the start of their input split, in the order of ``_id`` there."""
    reader = spark.read.options(**options)
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )


def counted_splits(scan: DataFrame, *extra: Column) -> DataFrame:
    """``path, _block, _first, _n, _before`` and ``extra`` for each split of ``split_lines``: its first id, its lines and
    the lines of its file before it."""
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = scan.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), *extra)
    return splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def numbered_lines(spark: SparkSession, path, line_sep: str | None = None, **options) -> DataFrame:
    """``path, line_no, value``, 1-based over each whole file.

    A file may be read in several splits. Rows of one split keep their order, so a line's number
    is its place in the split plus the lines of the splits before it. The per-split counts are
    one small row per split and are broadcast, by ``file_groups`` of bounded size. The lines
    themselves are not shuffled to be numbered.
    """
    def read(files) -> DataFrame:
        scan = split_lines(spark, files, line_sep, **options)
        splits = counted_splits(scan).select("path", "_block", "_first", "_before")
        return scan.join(F.broadcast(splits), ["path", "_block"]).select(
            "path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "value")

    return by_group(spark, path, options, read)


def heads(lines: DataFrame, n_bytes: int = SNIFF_BYTES) -> DataFrame:
    """``path, head``: the first ``n_bytes`` of every file as text. At most that many lines of a
    file can be part of it, so the window below is bounded per file."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("value") + 1
    first = lines.filter(F.col("line_no") <= n_bytes).withColumn(
        "_at", F.coalesce(F.sum(size).over(w), F.lit(0))
    ).filter(F.col("_at") < n_bytes)
    cut = F.struct("line_no", F.expr(f"substr(value, 1, cast({n_bytes} - _at as int))").alias("v"))
    return first.groupBy("path").agg(F.sort_array(F.collect_list(cut)).alias("_l")).select(
        "path", F.array_join(F.transform("_l", lambda x: x["v"]), "\n").alias("head")
    )


def vendor_of(head: Column) -> Column:
    """Layout of a consumer genotype export, null if it is none."""
    low = F.lower(head)
    body = F.ltrim(head)
    first = F.substring_index(body, "\n", 1)
    data = F.filter(F.split(head, "\n"), lambda l: (l != "") & ~l.startswith("#"))
    width = F.size(F.split(F.get(data, F.lit(0)), "\t"))
    shaped = first.startswith("# rsid") | first.startswith("rsid\tchromosome")
    return (
        F.when(low.contains("23andme"), F.lit("23andme"))
        .when(low.contains("ancestrydna") | low.contains("ancestry.com"), F.lit("ancestrydna"))
        .when(low.contains("myheritage"), F.lit("myheritage"))
        .when(F.upper(body).startswith("RSID,CHROMOSOME,POSITION,RESULT"), F.lit("myheritage"))
        .when(shaped & (width == 4), F.lit("23andme"))
        .when(shaped & (width == 5), F.lit("ancestrydna"))
    )


def assembly_of(head: Column) -> Column:
    """GRCh38 is looked for first."""
    low = F.lower(head)
    return F.when(low.contains("build 38") | low.contains("grch38"), F.lit("GRCh38")).when(
        low.contains("build 37") | low.contains("grch37"), F.lit("GRCh37")
    )


_EXT = {
    "fasta": ("fasta", "fa", "fna", "faa", "ffn", "frn"),
    "fastq": ("fastq", "fq"),
    "gff": ("gff", "gff3"),
}
_INDEXES = {"fasta": ("fai",), "vcf": ("tbi", "csi"), "bam": ("bai", "csi"), "cram": ("crai",), "bed": ("tbi",)}


def file_catalog(spark: SparkSession, path, **options) -> DataFrame:
    """One row per file: ``path, format, compressed, size_bytes, index_present, gzip_mismatch,
    assembly, record_estimate``. Format and estimate follow the first 4 KB and 64 KB, and no more is read of
    a file (in a store that tasks can't open, its lines are). An estimate goes by the size as it reads: of a
    gzip file the one that the file states. Empty files are ``unknown`` without an estimate."""
    files = listing(spark, path, **options)
    if ranges.opens(spark, path):
        d = sampled(files)
    else:
        lines = numbered_lines(spark, path, **options)
        head = heads(lines).withColumn("path", plain_path("path"))
        d = files.join(head, "path", "left").withColumn("head", F.coalesce("head", F.lit("")))
        d = d.join(_sample_counts(lines), "path", "left")
    name = F.lower(F.substring_index("path", "/", -1))
    gz = name.endswith(".gz")
    stem = F.when(gz, F.regexp_replace(name, r"\.gz$", "")).otherwise(name)
    d = d.withColumns({"_gz": gz, "_ext": F.when(stem.contains("."), F.substring_index(stem, ".", -1)).otherwise(F.lit(""))})
    ext, h = F.col("_ext"), F.col("head")
    text = F.ltrim(h)
    ls = F.split(h, LINE_END)
    fastq = (F.size(ls) >= 4) & F.get(ls, F.lit(0)).startswith("@") & F.get(ls, F.lit(2)).startswith("+")
    fmt = (
        F.when((F.col("_magic") == "4352414D") | (ext == "cram"), F.lit("cram"))
        .when((ext == "bam") | h.startswith("BAM\x01"), F.lit("bam"))
        .when(ext == "sam", F.lit("sam"))
        .when((ext == "vcf") | h.startswith("##fileformat=VCF"), F.lit("vcf"))
        .when(ext.isin(*_EXT["gff"]) | h.startswith("##gff-version"), F.lit("gff"))
        .when(ext == "gtf", F.lit("gtf"))
        .when(vendor_of(h).isNotNull(), F.concat(F.lit("consumer_dna:"), vendor_of(h)))
        .when(text.startswith(">") | ext.isin(*_EXT["fasta"]), F.lit("fasta"))
        .when((text.startswith("@") | ext.isin(*_EXT["fastq"])) & fastq, F.lit("fastq"))
        .when(ext == "bed", F.lit("bed"))
        .otherwise(F.lit("unknown"))
    )
    d = d.withColumn("format", fmt)
    is_gz = F.coalesce(F.col("_magic").startswith("1F8B"), F.col("_gz"))
    d = d.withColumn("_records", _records(F.col("format")))
    total = F.when(is_gz, F.col("_bytes")).otherwise(F.col("length"))
    ratio = F.greatest(F.lit(1.0), total / F.least(F.greatest(F.col("_bytes"), F.lit(1)), F.lit(SAMPLE_BYTES)))
    estimate = F.when(~F.col("format").isin("bam", "cram", "unknown"),
                      F.when(F.col("_bytes") <= SAMPLE_BYTES, F.col("_records"))
                      .otherwise(F.floor(F.col("_records") * ratio)))
    kinds = F.create_map(*[x for k, v in _INDEXES.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    wanted = d.select("path", F.coalesce(F.try_element_at(kinds, F.col("format")), F.array().cast("array<string>")).alias("_e"))
    wanted = unnest(wanted, ["path"], F.col("_e"), "_x").select(
        F.col("path").alias("_owner"), F.concat("path", F.lit("."), "_x").alias("path"))
    present = wanted.join(files.select("path"), "path", "left_semi").select(
        F.col("_owner").alias("path")).distinct().withColumn("_has", F.lit(True))
    return d.join(present, "path", "left").select(
        "path", "format",
        F.when(F.col("format") == "cram", F.lit(False)).when(F.col("format") == "bam", F.lit(True))
        .otherwise(F.col("_gz")).alias("compressed"),
        F.col("length").alias("size_bytes"),
        F.coalesce("_has", F.lit(False)).alias("index_present"),
        (F.coalesce(F.col("_magic").startswith("1F8B"), F.col("_gz")) != F.col("_gz")).alias("gzip_mismatch"),
        assembly_of(h).alias("assembly"),
        estimate.cast("bigint").alias("record_estimate"),
    )


def sampled(files: DataFrame) -> DataFrame:
    """``path, length, head``, the first four bytes, line-kind counts over the first 64 KB, and the size as the file
    reads, from one bounded read of each file."""
    d = ranges.heads(files, SAMPLE_BYTES, SNIFF_BYTES)
    ls = F.split("sample", LINE_END)

    def n(test) -> Column:
        return F.size(F.filter(ls, test))

    return d.select(
        "path", "length", "head", "magic", F.col("magic").alias("_magic"), F.col("total").alias("_bytes"), "bytes_read",
        n(lambda v: v.startswith(">")).alias("_fasta"), n(lambda v: v != "").alias("_full"),
        n(lambda v: (v != "") & ~v.startswith("#")).alias("_vcf"),
        n(lambda v: (v != "") & ~v.startswith("#") & ~v.startswith("track")).alias("_bed"),
        n(lambda v: (v != "") & ~v.startswith("#") & ~F.lower(v).startswith("rsid")).alias("_dna"),
        n(lambda v: (v != "") & ~v.startswith("@")).alias("_sam"))


def _sample_counts(lines: DataFrame) -> DataFrame:
    """Line-kind counts over the first 64 KB of every file, its unpacked size in bytes, and its first
    bytes. A line's bytes are kept as they are, so this holds for files that are no text."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("value") + 1
    start = F.hex(F.substring(F.col("value").cast("binary"), 1, 4))
    whole = lines.groupBy("path").agg(
        F.sum(size).alias("_bytes"), F.max(F.when(F.col("line_no") == 1, start)).alias("_magic"))
    s = lines.filter(F.col("line_no") <= SAMPLE_BYTES).withColumn(
        "_at", F.coalesce(F.sum(size).over(w), F.lit(0))).filter(F.col("_at") < SAMPLE_BYTES)
    v = F.col("value")
    full = v != ""
    hash_ = v.startswith("#")
    counts = s.groupBy("path").agg(
        F.count_if(v.startswith(">")).alias("_fasta"), F.count_if(full).alias("_full"),
        F.count_if(full & ~hash_).alias("_vcf"), F.count_if(full & ~hash_ & ~v.startswith("track")).alias("_bed"),
        F.count_if(full & ~hash_ & ~F.lower(v).startswith("rsid")).alias("_dna"),
        F.count_if(full & ~v.startswith("@")).alias("_sam"),
    ).join(whole, "path")
    return counts.withColumn("path", plain_path("path"))


def _records(fmt: Column) -> Column:
    return (
        F.when(fmt == "fasta", F.col("_fasta")).when(fmt == "fastq", F.expr("_full div 4"))
        .when(fmt == "vcf", F.col("_vcf")).when(fmt.isin("bed", "gff", "gtf"), F.col("_bed"))
        .when(fmt.startswith("consumer_dna"), F.col("_dna")).when(fmt == "sam", F.col("_sam"))
    )


def source_line_accounting(lines: DataFrame, data_columns: int = 4) -> DataFrame:
    """Per file: all lines as comments, column header, data rows, blanks and malformed rows."""
    v = F.col("value")
    blank = strip(v) == ""
    comment = v.startswith("#")
    header = ~comment & (F.lower(F.substring_index(F.translate(v, ",", "\t"), "\t", 1)) == "rsid")
    wide = F.size(F.split(F.translate(v, ",", "\t"), "\t")) >= data_columns
    other = ~blank & ~comment & ~header
    return lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if(comment).alias("comment_lines"),
        F.count_if(header).alias("header_lines"), F.count_if(other & wide).alias("data_rows"),
        F.count_if(blank).alias("blank_lines"), F.count_if(other & ~wide).alias("malformed_rows"),
    )
