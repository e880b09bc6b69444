"""Writers. Spark's commit protocol makes each write all-or-nothing; a job writes a folder of
part files. Where a format has header lines they go to a side file of the same folder name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import sequence as S
from ..operators.keyed import value_lists, whole_lists
from ..session import fixed_rows
from . import ranges
from .lines import hidden_files, listing, plain_path


#: Stands for no quote character: no character, so no value begins with it (an empty setting means NUL, which texts hold).
NO_QUOTE = "\uffff"


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Delimited text with a header in every part; nulls are empty. Values stand as they are, with their quotes and
    outer spaces: the readers split at ``sep`` and unquote nothing."""
    plain = {"quote": NO_QUOTE, "escapeQuotes": "false", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.options(sep=sep, header="true", nullValue="", emptyValue="", **plain).csv(path)


def _tabbed(cols) -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def _header(df: DataFrame, lines: list[str], path: str) -> None:
    fixed_rows(df.sparkSession, [("\n".join(lines),)], "value string").write.text(path + "_header")


def write_fasta(df: DataFrame, path: str, header: str = "header", sequence: str = "sequence", width: int = 70) -> None:
    """``>header`` and the sequence in lines of ``width``; one row is one record."""
    seq = F.col(sequence)
    record = F.concat(F.lit(">"), F.col(header),
                      F.when(F.length(seq) > 0, F.concat(F.lit("\n"), S.wrap_fixed(seq, width))).otherwise(F.lit("")))
    df.select(record.alias("value")).write.text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.text(path)


def part_folder(column: str) -> Column:
    """The folder ``column=value`` as Spark's partitioned writes name it."""
    v = F.col(column).cast("string")
    special = r"[\x01-\x1F\x7F\"#%'*/:=?\\{\[\]^]"
    coded = F.transform(F.split(v, ""), lambda c: F.when(c.rlike(special), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    plain = F.when(v.rlike(special), F.array_join(coded, "")).otherwise(v)
    return F.concat(F.lit(f"{column}="), F.coalesce(F.when(v != "", plain), F.lit("__HIVE_DEFAULT_PARTITION__")))


def write_vcf(df: DataFrame, path: str, assembly: str = "GRCh37", group: str | None = "sample_id") -> None:
    """Ten-column rows of ``calls_to_vcf``, one folder per sample; five header lines beside."""
    cols = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "gt")
    body = _tabbed(cols).alias("value")
    if group and not ranges.opens(df.sparkSession, path):
        df.select(group, body).hint("rebalance", group).write.partitionBy(group).text(path)
    elif group:
        # Rebalancing gathers a sample's rows for few files and splits a sample that is large. Tasks write the files: a
        # partitioned write makes, checks and renames folders for each sample, which costs far more than its rows.
        rows = df.select(group, body).hint("rebalance", group).sortWithinPartitions(group)
        name = F.concat(part_folder(group), F.lit("/part-"), F.spark_partition_id().cast("string"), F.lit(".txt"))
        ranges.write_lines(rows.select(name.alias("name"), "value"), ranges.qualified(df.sparkSession, path))
    else:
        df.select(body).write.text(path)
    _header(df, [
        "##fileformat=VCFv4.2", "##source=locusgrid", f"##reference={assembly}",
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"], path)


def write_gff(df: DataFrame, path: str) -> None:
    cols = ("seqid", "source", "feature_type", "start1", "end1", "score", "strand", "phase", "attributes")
    df.select(_tabbed(cols).alias("value")).write.text(path)
    _header(df, ["##gff-version 3"], path)


def write_bed(df: DataFrame, path: str) -> None:
    df.select(_tabbed(("chrom", "start0", "end0", "name", "score", "strand")).alias("value")).write.text(path)


def index_rows(index: DataFrame, sources: DataFrame) -> DataFrame:
    """The seven INDEX columns with ``part_no``: sorted source documents joined by commas. An id
    cited by more documents than one value should hold has further rows, numbered by part."""
    lists = value_lists(sources.withColumn("doc", F.col("doc").cast("string")), "rsid", "doc", "source_docs")
    return index.join(lists, "rsid", "left").select(
        "first_doc", "first_pos", F.coalesce("part_no", F.lit(0).cast("bigint")).alias("part_no"),
        "rsid", "chromosome", "position", "genotype", "found",
        F.coalesce("source_docs", F.lit("")).alias("source_docs"), "discovered_in_phase")


def index_sources(index: DataFrame, sources: DataFrame) -> DataFrame:
    """The seven INDEX columns, one row for each id with all its source documents, sorted and joined by commas."""
    lists = whole_lists(sources.withColumn("doc", F.col("doc").cast("string")), "rsid", "doc", "source_docs")
    return index.join(lists, "rsid", "left").select(*K.INDEX_COLUMNS)


def write_index(index: DataFrame, sources: DataFrame, path: str) -> None:
    """INDEX table in pool order (first document, first place in it). ``part_no`` follows the fixed
    columns: an id with very many documents has several rows that differ in their documents."""
    rows = index_rows(index, sources).orderBy("first_doc", "first_pos", "part_no")
    write_table(rows.select(*K.INDEX_COLUMNS, "part_no"), path)


def write_claims(claims: DataFrame, path: str, key: str = "doc") -> None:
    """Flat table sorted by document and line, and the nested rows as JSON beside it. The claims are
    computed once, for the JSON; the table is made from that."""
    claims.write.json(path + "_json")
    claims = claims.sparkSession.read.schema(claims.schema).json(path + "_json")
    def joined(c):
        return F.array_join(c, ",")

    flat = claims.select(
        key, "lineno", "disposition", joined("supporting").alias("supporting_rsids"),
        joined("absent").alias("rsids_absent"), F.when(F.col("has_citation"), "y").otherwise("n").alias("has_citation"),
        joined("tokens").alias("blacklist_tokens"), joined("project_terms").alias("project_terms"),
        F.when(F.col("genotype_mismatch"), "y").when(~F.col("genotype_mismatch"), "n").otherwise("").alias("genotype_mismatch"),
        F.translate("text", "\t", " ").alias("text"))
    write_table(flat.orderBy(key, "lineno"), path)


def write_candidates(candidates: DataFrame, path: str, evidence: dict[str, DataFrame] | None = None) -> None:
    """INDEX-shaped rows of phase 6, the candidates as JSON, and every evidence table beside. The
    candidates are computed once, for the JSON; the table is made from that."""
    candidates.write.json(path + "_json")
    candidates = candidates.sparkSession.read.schema(candidates.schema).json(path + "_json")
    rows = candidates.select(
        "rsid", F.col("chrom").alias("chromosome"), F.col("pos").alias("position"), "genotype",
        F.lit("y").alias("found"), F.lit(K.DISCOVERY_SOURCE).alias("source_docs"), F.lit(6).alias("discovered_in_phase"))
    write_table(rows.orderBy("rsid"), path)
    for name, df in (evidence or {}).items():
        df.write.json(f"{path}_{name}")


def write_docs(docs: DataFrame, path: str, name: str = "doc", text: str = "text") -> int:
    """One file for each document, named ``<name>.md`` (a name may hold folders); the number of files. Names must be
    unique: of documents with one name any may be the one that stays."""
    named = docs.select(F.concat(F.col(name).cast("string"), F.lit(".md")).alias("name"), F.coalesce(text, F.lit("")).alias("content"))
    return ranges.write_each(named, ranges.qualified(docs.sparkSession, path)).count()


def append_index(rows: DataFrame, path: str) -> None:
    """Adds rows to an INDEX table kept as Parquet by phase; earlier phases stay as they are."""
    rows.write.mode("append").partitionBy("discovered_in_phase").parquet(path)


def file_fingerprint(spark, path, **options) -> DataFrame:
    """``path, sha256`` of every file's bytes, empty and hidden files too. A task runs a file through its hash block by
    block, so its length doesn't matter. In a store that tasks can't open, a file longer than Spark reads as one
    value is refused by name."""
    files = listing(spark, path, **options)
    if ranges.opens(spark, path):
        return ranges.digests(files)
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    large = [r["path"] for r in files.filter(F.col("length") > most).limit(5).collect()]
    if large:
        raise ValueError(f"too long to hash as one value (over {most} bytes): {', '.join(large)}")
    empty = files.filter("length = 0").select("path", F.sha2(F.lit(""), 256).alias("sha256"))
    read = spark.read.format("binaryFile").options(**options).load(path).select("path", "content")
    read = read.unionByName(hidden_files(files))
    return read.select(plain_path("path").alias("path"), F.sha2("content", 256).alias("sha256")).unionByName(empty)
