"""Byte ranges of files and listings of folders, read by tasks.

A folder tree is a table of folders that tasks expand; what a head or a hash needs of a file is a byte range
or a stream that a task opens. So a file's name, length and content don't matter, and the driver neither
lists nor reads. Stores that only Spark's own readers can open (see ``opens``) are read by these instead.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_path

#: Stores that a task can open by itself.
SCHEMES = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
#: Entries that a task lists below one folder before it hands the folders that are left to other tasks.
ENTRIES_PER_TASK = 10_000
#: Files whose ranges one task reads.
FILES_PER_TASK = 2_000
STREAM_BYTES = 1 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its store, which may be the session's default one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return hadoop.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()


def opens(spark: SparkSession, path) -> bool:
    """Whether tasks can open these paths themselves."""
    paths = [path] if isinstance(path, str) else path
    return all(qualified(spark, p).split(":", 1)[0] in SCHEMES for p in paths)


def store_of(path: str):
    """(file system, path in it); a path without a scheme is local."""
    local = re.sub("^file:/+", "/", path)
    if local.startswith("/"):
        return arrow_fs.LocalFileSystem(), local
    return arrow_fs.FileSystem.from_uri(path)


def _tuples(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[tuple]], ddl: str, size: int = 256) -> DataFrame:
    """``rows`` turns the rows of a partition into tuples of ``ddl``."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def batches(parts: Iterator[pa.RecordBatch]):
        held = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)

        for row in rows(r for part in parts for r in part.to_pylist()):
            held.append(row)
            if len(held) >= size:
                yield batch()
                held = []
        if held:
            yield batch()

    return df.mapInArrow(batches, ddl)


# --- listings --------------------------------------------------------------------------

def counts(name: str, pattern: str | None) -> bool:
    """Whether a file is listed: all but Hadoop's own marks, and by name where a pattern is given."""
    return name != "_SUCCESS" and not name.endswith(".crc") and (pattern is None or fnmatch(name, pattern))


def expand(folders: DataFrame, deep: bool, pattern: str | None, most: int = ENTRIES_PER_TASK) -> DataFrame:
    """(path, length, todo) from ``folders`` (path): files, and with ``todo`` the folders below that are still
    to be expanded. Part folders (``key=value``) always count, others with ``deep``."""
    def rows(given: Iterator[dict]):
        for row in given:
            store, top = store_of(row["path"])
            prefix = row["path"][:len(row["path"]) - len(top)] if row["path"].endswith(top) else ""
            todo, seen = [top], 0
            while todo:
                folder = todo.pop()
                if seen > most:
                    yield prefix + folder, None, True
                    continue
                for info in store.get_file_info(arrow_fs.FileSelector(folder)):
                    seen += 1
                    if info.type == arrow_fs.FileType.Directory:
                        if deep or "=" in info.base_name:
                            todo.append(info.path)
                    elif counts(info.base_name, pattern):
                        yield prefix + info.path, info.size, False

    return _tuples(folders, rows, "path string, length bigint, todo boolean", 4096)


def listing(spark: SparkSession, path, recursiveFileLookup="false", pathGlobFilter=None, **_) -> DataFrame:
    """``path, length`` of all files of ``path`` (a file, a folder or a pattern), see ``counts``. Each level of the
    frontier is one job and a stored table; the driver learns only whether folders are left."""
    deep = str(recursiveFileLookup).lower() == "true"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files, folders = [], []
    for p in [path] if isinstance(path, str) else path:
        hadoop = jvm.org.apache.hadoop.fs.Path(p)
        for status in hadoop.getFileSystem(conf).globStatus(hadoop) or []:  # what the pattern itself names
            where = re.sub("^file:/+", "/", status.getPath().toString())
            if status.isDirectory():
                folders.append((where,))
            elif counts(status.getPath().getName(), pathGlobFilter):
                files.append((where, status.getLen()))
    found = spark.createDataFrame(files, "path string, length bigint")
    frontier = spark.createDataFrame(folders, "path string") if folders else None
    while frontier is not None:
        out = scratch_path(spark, "listing")
        expand(frontier, deep, pathGlobFilter).write.parquet(out)
        level = spark.read.schema("path string, length bigint, todo boolean").parquet(out)
        found = found.unionByName(level.filter("not todo").select("path", "length"))
        left = level.filter("todo").select("path")
        # A folder is a small row; dealt one by one, so that large folders don't share a task.
        frontier = None if left.isEmpty() else left.repartition(spark.sparkContext.defaultParallelism, "path")
    return found


def scan_path(path: str) -> str:
    """A listed path as Spark's scans name it: with its scheme, and escaped as Java does in a path."""
    escaped = "".join(c if c.isalnum() or c in "_-!.~'()*,;:$&+=/@" or ord(c) > 127 else f"%{ord(c):02X}" for c in path)
    return "file://" + escaped if path.startswith("/") else escaped


# --- heads -------------------------------------------------------------------------------

def unpacked(raw: bytes, most: int) -> tuple[bytes, int, int]:
    """(up to ``most`` bytes, members seen, bytes of ``raw`` used) of a gzip file's beginning; damaged data end it."""
    out, rest, members = b"", raw, 0
    while rest and len(out) < most:
        part = zlib.decompressobj(31)
        try:
            out += part.decompress(rest, most - len(out))
        except zlib.error:
            break
        members += 1
        if not part.eof:
            rest = part.unconsumed_tail
            break
        rest = part.unused_data
    return out, members, len(raw) - len(rest)


def head_of(stream, length: int, n_bytes: int) -> dict:
    """The first ``n_bytes`` of an open file as they read: of a gzip file the unpacked ones, from no more packed ones.

    ``total`` is the unpacked size: a gzip file's own entry for it, or by the sample's ratio where the file
    has several members, whose entries count one member each."""
    raw = stream.read(min(n_bytes, length))
    out = {"magic": raw[:4].hex().upper(), "sample": raw, "total": length}
    if raw[:2] == b"\x1f\x8b":
        sample, members, used = unpacked(raw, n_bytes)
        if used >= length and len(sample) < n_bytes:
            total = len(sample)
        elif members > 1:
            total = max(len(sample), int(length * len(sample) / max(1, used)))
        else:
            stream.seek(length - 4)
            total = max(len(sample), int.from_bytes(stream.read(4), "little"))
        out |= {"sample": sample, "total": total}
    return out


def plain_blocks(stream, is_gzip: bool, size: int) -> Iterator[bytes]:
    """The content of an open file from its start, unpacked, in pieces."""
    stream.seek(0)
    part = zlib.decompressobj(31)
    while raw := stream.read(size):
        if not is_gzip:
            yield raw
        while is_gzip and raw:
            yield part.decompress(raw)
            raw = part.unused_data
            if part.eof:
                part = zlib.decompressobj(31)


def first_data(blocks: Iterator[bytes], ends: bool = True) -> tuple[int | None, str | None]:
    """(line number, text) of the first line that is neither blank nor a comment; the last piece of ``blocks`` is a
    line only where the file ``ends`` with it."""
    rest, n = b"", 0
    for block in blocks:
        *ready, rest = re.split(rb"\r\n|\n|\r(?!$)", rest + block)
        for line in ready:
            n += 1
            if line.strip() and not line.strip().startswith(b"#"):
                return n, line.decode("utf-8", "replace")
    if ends and rest.strip() and not rest.strip().startswith(b"#"):
        return n + 1, rest.decode("utf-8", "replace").rstrip("\r")
    return None, None


class Counted:
    """An open file that counts the bytes read from it."""

    def __init__(self, stream):
        self.stream, self.bytes_read, self.seek = stream, 0, stream.seek

    def read(self, n: int) -> bytes:
        got = self.stream.read(n)
        self.bytes_read += len(got)
        return got


def heads(files: DataFrame, n_bytes: int, head_bytes: int, data_line: bool = False) -> DataFrame:
    """``path, scan_path, length, magic, head, sample, total, sample_bytes, bytes_read, first_data_line, first_line`` of ``files``
    (path, length). ``head`` and ``sample`` are the first ``head_bytes`` and ``n_bytes`` as text. The last two are only
    looked for with ``data_line``; a file is read on for them if comments fill the sample. A file that is gone or
    can't be read fails the job."""
    def rows(given: Iterator[dict]):
        for f in given:
            found, line, text, read = {"magic": "", "sample": b"", "total": 0}, None, None, 0
            if f["length"]:
                store, inner = store_of(f["path"])
                with store.open_input_file(inner) as opened:
                    stream = Counted(opened)
                    found = head_of(stream, f["length"], n_bytes)
                    if data_line:
                        whole = found["total"] <= len(found["sample"])
                        line, text = first_data(iter([found["sample"]]), whole)
                        if line is None and not whole:
                            line, text = first_data(plain_blocks(stream, found["magic"].startswith("1F8B"), n_bytes))
                    read = stream.bytes_read
            sample = found["sample"]
            yield (f["path"], scan_path(f["path"]), f["length"], found["magic"], sample[:head_bytes].decode("utf-8", "replace"),
                   sample.decode("utf-8", "replace"), found["total"], len(sample), read, line, text)

    return _tuples(dealt(files), rows, "path string, scan_path string, length bigint, magic string, head string, sample string, total bigint, "
                                       "sample_bytes bigint, bytes_read bigint, first_data_line bigint, first_line string", 64)


def dealt(files: DataFrame, per_task: int = FILES_PER_TASK) -> DataFrame:
    """``files`` over enough tasks that none opens many of them."""
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // per_task))
    return files.repartition(tasks, "path")


# --- whole files as streams --------------------------------------------------------------

def digests(files: DataFrame, block: int = STREAM_BYTES) -> DataFrame:
    """``path, sha256`` of ``files`` (path, length): each file runs through its hash block by block."""
    def rows(given: Iterator[dict]):
        for f in given:
            store, inner = store_of(f["path"])
            digest = hashlib.sha256()
            with store.open_input_stream(inner, compression=None) as stream:
                while part := stream.read(block):
                    digest.update(part)
            yield f["path"], digest.hexdigest()

    return _tuples(dealt(files.select("path"), 64), rows, "path string, sha256 string")


def texts(files: DataFrame) -> DataFrame:
    """``path, content``: the files' bytes, hidden ones too; for files that are one value (documents)."""
    def rows(given: Iterator[dict]):
        for f in given:
            store, inner = store_of(f["path"])
            with store.open_input_stream(inner, compression=None) as stream:
                yield f["path"], stream.read()

    return _tuples(dealt(files.select("path")), rows, "path string, content binary", 16)


def write_each(files: DataFrame, root: str) -> DataFrame:
    """Writes each row of ``files`` (name, content) to a file of that name below ``root`` and returns ``name, length``.
    Lazy: the files are there once the result is used. A task that runs again writes the same files again."""
    def rows(given: Iterator[dict]):
        store, top = store_of(root)
        for f in given:
            where = f"{top.rstrip('/')}/{f['name']}"
            store.create_dir(where.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(where, compression=None) as stream:
                stream.write(f["content"])
            yield f["name"], len(f["content"])

    return _tuples(files.select("name", F.col("content").cast("binary").alias("content")), rows, "name string, length bigint")


def write_lines(lines: DataFrame, root: str, head: str | None = None) -> int:
    """Writes the rows of ``lines`` (name, value) to a file for each name in the new folder ``root``, ``head`` first; the
    number of files. A null value is an empty line. All rows of a name must follow each other in one partition. A task
    holds one batch and one open file, and makes no folder but those of the names, so many small files are cheap.
    A file is moved to its place once it is whole, so a task that runs again replaces it, and the folder once all are there."""
    first = (head + "\n").encode() if head else b""
    work = f"{root.rstrip('/')}-unfinished-{uuid.uuid4().hex}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(work)
        attempt, made = f"{top}/attempts/{uuid.uuid4().hex}", set()
        store.create_dir(attempt, recursive=True)
        name, stream, done = None, None, 0

        def close():
            stream.close()
            place = f"{top}/files/{name}"
            folder = place.rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            store.move(f"{attempt}/lines", place)

        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            ends = runs.run_ends.to_pylist()
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), batch.column(1)), "\n")
            for now, text in zip(runs.values.to_pylist(), joined.to_pylist()):
                if now != name:
                    if stream:
                        close()
                        done += 1
                    name, stream = now, store.open_output_stream(f"{attempt}/lines", compression=None)
                    stream.write(first)
                stream.write(text.encode() + b"\n")
        if stream:
            close()
            done += 1
        store.delete_dir(attempt)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["files"])

    store, top = store_of(root.rstrip("/"))
    if store.get_file_info(top).type != arrow_fs.FileType.NotFound:
        raise FileExistsError(root)
    unfinished = store_of(work)[1]
    store.create_dir(f"{unfinished}/files", recursive=True)
    written = lines.select("name", F.coalesce("value", F.lit("")).alias("value")).mapInArrow(rows, "files bigint")
    n = written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
    store.move(f"{unfinished}/files", top)
    store.delete_dir(unfinished)
    return n
