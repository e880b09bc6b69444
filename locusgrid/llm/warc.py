"""Legacy web archives: ARC files read, converted to WARC records, written, and read again.

An ARC file begins with a version block that names the fields of its header lines (five in version 1,
ten in version 2). Records follow: a header line that ends with the declared length, then that many
bytes. An archive may be compressed, each record as a gzip member of its own. A WARC record is synthesised
for each: an identifier from its archive, place and contents, the date in ISO form, the type, and SHA-1
digests of block and payload. Of records with equal payloads of a given size one is written in full, the
others refer to it.

Archives are rows or files of bounded size, so every task parses whole ones. Records are brought
together only by digest; a hot digest is aggregated before the shuffle and its join may be split.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import map_rows, stored

ARCHIVE_BYTES = 4 << 20
GROUP_BYTES = 8 << 20
GZIP = b"\x1f\x8b"
GZIP_LEVEL = 1
REVISIT_FROM = 1000
DATE = "20240101000000"
# Header fields by version, and WARC's own strings.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BETWEEN = "\r\n\r\n"


def page_uri(page_id: int | None, url: str | None) -> str:
    """A page's name in archives: its id, and its URL without white space."""
    return f"page://{'-' if page_id is None else page_id}/" + ("-" if url is None else "u" + quote(url, safe=":/?#=&"))


def page_of(uri: str) -> tuple[int | None, str | None]:
    page, _, url = uri.removeprefix("page://").partition("/")
    return (None if page == "-" else int(page)), (None if url == "-" else unquote(url[1:]))


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def arc_head(name: str, version: int) -> bytes:
    block = f"{version} 0 crawl\n{FIELDS[version]}\n\n".encode()
    rest = f"200 - - 0 {name} {len(block)}" if version == 2 else f"{len(block)}"
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain {rest}\n".encode() + block


def arc_record(uri: str, payload: bytes, version: int, name: str, offset: int) -> bytes:
    block = http_head(len(payload)) + payload
    rest = f"200 - - {offset} {name} {len(block)}" if version == 2 else f"{len(block)}"
    return f"{uri} 0.0.0.0 {DATE} text/html {rest}\n".encode() + block + b"\n"


def arc_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 most: int = ARCHIVE_BYTES, compress: bool = True) -> DataFrame:
    """(name, content): the pages as ARC archives, versions 1 and 2 in turn, named by task and number. An
    archive ends with the record that fills it, counted before compression; offsets are those in the file."""
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                          F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))

    def packed(record: bytes) -> bytes:
        return gzip.compress(record, GZIP_LEVEL, mtime=0) if compress else record

    def rows(batches: Iterator[pa.RecordBatch]):
        task, n, parts = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for page, url, html in zip(*batch.columns):
                if not parts:
                    n += 1
                    name, version = f"pages-{task:06d}-{n:06d}.arc" + (".gz" if compress else ""), 1 + n % 2
                    head = arc_head(name, version)
                    parts, size = [packed(head)], len(head)
                    offset = len(parts[0])
                record = arc_record(page_uri(page.as_py(), url.as_py()), html.as_py(), version, name, offset)
                parts.append(packed(record))
                size, offset = size + len(record), offset + len(parts[-1])
                if size >= most:
                    yield name, b"".join(parts)
                    parts = []
        if parts:
            yield name, b"".join(parts)

    return map_rows(picked, rows, "name string, content binary", 1)


def stored_archives(archives: DataFrame) -> DataFrame:
    """Archives kept in the shared folder, in row groups of a few archives: a task that writes or reads them
    holds one group."""
    spark = archives.sparkSession
    path = scratch_path(spark, "arc")
    archives.write.options(**{"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1,
                              "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}).parquet(path)
    return spark.read.schema(archives.schema).parquet(path)


def read_arc_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of ARC files in a folder, plain or compressed; files of up to 2 GB."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")


def arc_records(name: str, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record. The version block says which fields there are; a URL may
    hold spaces, the other fields may not. What doesn't fit its declared length is an error. Gzip members,
    one a record or otherwise, are read as a stream; one that is cut short is an error."""
    source = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == GZIP else io.BytesIO(data)
    names = None
    while True:
        at = source.tell()
        try:
            line = source.readline()
            if not line:
                return
            head = line.strip(b"\r\n").decode("utf-8", "surrogateescape")
            if not head:
                continue
            version_block = head.startswith("filedesc://")
            if names is None and not version_block:
                raise ValueError(f"{name}: a record before the version block at {at}")
            declared = head.rsplit(" ", 1)[-1]
            if not line.endswith(b"\n") or not (declared.isascii() and declared.isdigit()):
                raise ValueError(f"{name}: malformed record at {at}")
            content = source.read(int(declared))
        except (EOFError, OSError, zlib.error) as error:
            raise ValueError(f"{name}: damaged gzip member at or after {at}") from error
        if version_block:
            first, second = (content.split(b"\n") + [b"", b""])[:2]
            version, names = first.split()[:1], second.decode("utf-8", "replace").split()
            if version not in [[str(v).encode()] for v in FIELDS] or names[-1:] != ["Archive-length"]:
                raise ValueError(f"{name}: unknown version block at {at}")
        values = head.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or len(content) != int(declared):
            raise ValueError(f"{name}: malformed record at {at}")
        if not version_block:
            yield dict(zip(names, values)), content


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload; a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def iso_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(archives: DataFrame, with_block: bool = True) -> DataFrame:
    """(record_id, uri, date, mime, type, payload_digest, payload_bytes, head, payload) of the records of
    ARC archives. ``type``: response for HTTP captures, else resource. The identifier comes from the archive's
    name, the record's number in it, URL, date and digest: equal records have different ones, and converting
    the archives again gives the same. ``with_block=False`` leaves head and payload null."""
    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                archive = name.as_py()
                for i, (fields, block) in enumerate(arc_records(archive, content.as_py())):
                    head, payload = split_http(block)
                    digest = hashlib.sha1(payload).hexdigest()
                    key = f"{archive} {i} {fields['URL']} {fields['Archive-date']} {digest}"
                    key = key.encode("utf-8", "surrogateescape").decode("latin-1")  # a URL may hold any bytes
                    yield (str(uuid.uuid5(uuid.NAMESPACE_URL, key)), fields["URL"], iso_date(fields["Archive-date"]),
                           fields["Content-type"], "response" if head else "resource", digest, len(payload),
                           head if with_block else None, payload if with_block else None)

    return map_rows(archives, rows, "record_id string, uri string, date string, mime string, type string, "
                                    "payload_digest string, payload_bytes long, head binary, payload binary", 64)


def revisited(records: DataFrame, order: F.Column, least: int = REVISIT_FROM) -> DataFrame:
    """(payload_digest, payload_bytes, winner): for payloads of ``least`` bytes and more that occur more
    than once, the record with the largest ``order`` (nulls last), as (order, uri, record_id)."""
    return (records.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
            .agg(F.max(F.struct(order.alias("order"), "uri", "record_id")).alias("winner"), F.count("*").alias("n"))
            .filter("n > 1").drop("n"))


def warc_record(r: dict) -> bytes:
    lines = [WARC_VERSION, f"WARC-Type: {r['type']}", f"WARC-Record-ID: <urn:uuid:{r['record_id']}>",
             f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['uri']}",
             f"WARC-Payload-Digest: sha1:{r['payload_digest']}"]
    block = r["head"] if r["type"] == "revisit" else r["head"] + r["payload"]
    if r["type"] == "revisit":
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <urn:uuid:{r['refers_to']['record_id']}>",
                  f"WARC-Refers-To-Target-URI: {r['refers_to']['uri']}"]
    http = r["head"].startswith(b"HTTP/")
    kind = "response" if r["type"] == "revisit" else r["type"]
    lines += [f"Content-Type: {f'application/http; msgtype={kind}' if http else r['mime']}",
              f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str, most: int = ARCHIVE_BYTES, compression: str = "gzip") -> None:
    """Records with a ``refers_to`` column, as WARC files of about ``most`` bytes (before compression) under
    ``path``. A file is one row of Spark's text writer, whose line end is the end of a record; compressed, it
    is one gzip member."""
    def rows(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                held.append(warc_record(r))
                size += len(held[-1])
                if size >= most:
                    yield (BETWEEN.encode().join(held),)
                    held, size = [], 0
        if held:
            yield (BETWEEN.encode().join(held),)

    files = map_rows(records, rows, "value binary", 1).select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", BETWEEN).option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path, compression=compression)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by its declared length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        begin = end + 4
        at = begin + int(headers["Content-Length"])
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record's length is wrong, before {at}")
        yield headers, data[begin:at]
        at += 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, uri, type, payload_bytes, payload_digest, refers_to_uri) of all records under ``path``,
    compressed or not.
    Length and digest of a payload are measured where it is there; a revisit's are those it declares."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").cast("binary").alias("value"))

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for data in batch.column(0):
                for headers, block in parse_warc(data.as_py()):
                    head, payload = split_http(block)
                    declared = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if headers["WARC-Type"] == "revisit":
                        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n")
                                    if x.lower().startswith(b"content-length:"))
                        digest = declared
                    elif digest != declared:
                        raise ValueError(f"{headers['WARC-Record-ID']}: the payload doesn't have its digest")
                    yield (headers["WARC-Record-ID"], headers["WARC-Target-URI"], headers["WARC-Type"], size, digest,
                           headers.get("WARC-Refers-To-Target-URI"))

    return map_rows(files, rows, "record_id string, uri string, type string, payload_bytes long, "
                                 "payload_digest string, refers_to_uri string")


def page_number(uri: str) -> F.Column:
    """The page id in a page's name; null where it has none."""
    return F.nullif(F.regexp_extract(uri, "^page://([0-9-]+)/", 1), F.lit("-")).try_cast("long")


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", least: int = REVISIT_FROM) -> DataFrame:
    """Pages to ARC, ARC to WARC files under ``path`` (a fresh shared folder if None), and those read back:
    (page_id, payload_bytes, payload_digest, record_type, refers_to, url).

    Null html is an empty payload; null URLs and ids come back as null. Of equal payloads of at least
    ``least`` bytes the record with the largest page_id is the response; rows that repeat that page_id with
    that payload are responses too, and each has an identifier of its own. A null id is never referred to.
    Other columns are ignored. An empty table gives no rows. The archives are stored once, so the record that
    others refer to is the one that is written.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    archives = stored_archives(arc_archives(pages, id_col, url_col, html_col))
    digests = stored(convert(archives, with_block=False).select("record_id", "uri", "payload_digest", "payload_bytes"),
                     "payload-digests")
    winners = stored(revisited(digests, page_number("uri"), least), "payload-winners")
    records = convert(archives)
    joined = records.join(winners, ["payload_digest", "payload_bytes"], "left")
    order = page_number("uri")
    revisit = F.col("winner.order").isNotNull() & (order.isNull() | (order < F.col("winner.order")))
    typed = joined.withColumn("refers_to", F.when(revisit, F.col("winner"))).withColumn(
        "type", F.when(revisit, "revisit").otherwise(F.col("type"))).withColumn(
        "payload", F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload"))).drop("winner")
    write_warc(typed, path)

    def url_of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                page, url = page_of(r["uri"])
                other = r["refers_to_uri"] and page_of(r["refers_to_uri"])[0]
                yield page, r["payload_bytes"], r["payload_digest"], r["type"], other, url

    return map_rows(read_warc(spark, path), url_of, "page_id long, payload_bytes long, payload_digest string, "
                                                    "record_type string, refers_to long, url string")
