"""Byte ranges, listings by tasks, and readers that shuffle no lines."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from locusgrid.sources import formats as R
from locusgrid.sources import lines as L
from locusgrid.sources import ranges


@pytest.fixture
def conf(spark):
    """Sets session values for a test."""
    old = {}

    def put(**values):
        for k, v in values.items():
            k = k.replace("__", ".")
            old.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)

    yield put
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_splits(conf, n=700):
    conf(**{"spark__sql__files__maxPartitionBytes": str(n), "spark__sql__files__openCostInBytes": "1"})


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_heads_read_no_more_than_they_need(spark, tmp_path):
    (tmp_path / "long.txt").write_text("# rsid\tchromosome\n" + "rs1\t1\t5\tAA\n" * 200_000)
    (tmp_path / "long.txt.gz").write_bytes(gzip.compress(b"# 23andMe\n" + bytes(random.Random(1).randbytes(2_000_000)), 1))
    (tmp_path / "short").write_text("x")
    (tmp_path / "none").write_text("")
    got = {r.path.rsplit("/", 1)[1]: r for r in ranges.heads(L.listing(spark, str(tmp_path)), 65536, 4096, True).collect()}
    assert got["long.txt"].bytes_read == 65536 and got["long.txt.gz"].bytes_read == 65540
    assert (got["short"].bytes_read, got["none"].bytes_read, got["none"].first_data_line) == (1, 0, None)
    assert got["long.txt.gz"].total == 2_000_010 and got["long.txt.gz"].head.startswith("# 23andMe")
    assert (got["long.txt"].first_data_line, got["long.txt"].first_line) == (2, "rs1\t1\t5\tAA")


@pytest.mark.parametrize("packed", [False, True])
def test_the_first_data_line_may_stand_behind_many_comments(spark, tmp_path, packed):
    text = "# MyHeritage\r\n" + "# note\n" * 30_000 + "\n  \nRSID,CHROMOSOME,POSITION,RESULT\nrs1,1,5,AA\n"
    path = tmp_path / ("a.csv.gz" if packed else "a.csv")
    half = len(text) // 2
    # Two members, as block compression writes them.
    path.write_bytes(gzip.compress(text[:half].encode()) + gzip.compress(text[half:].encode()) if packed else text.encode())
    fact = R.export_facts(spark, str(path)).first()
    assert (fact.vendor, fact.first_data_line, fact.first_line) == ("myheritage", 30_004, "RSID,CHROMOSOME,POSITION,RESULT")
    assert [(r.rsid, r.pos) for r in R.read_calls(spark, str(path)).collect()] == [("rs1", 5)]


def test_facts_from_heads_equal_facts_from_lines(spark, data):
    for name in ("me.txt", "ancestry.txt", "heritage.csv", "s.bed"):
        a = R.export_facts(spark, f"{data}/{name}").drop("path").first()
        b = R.export_files(L.numbered_lines(spark, f"{data}/{name}")).drop("path").first()
        assert a == b


def test_estimates_of_packed_files(spark, tmp_path):
    body = b"".join(b"chr1\t%d\t%d\n" % (i, i + 5) for i in range(60_000))
    (tmp_path / "one.bed.gz").write_bytes(gzip.compress(body))
    (tmp_path / "many.bed.gz").write_bytes(b"".join(gzip.compress(body[i:i + 20_000]) for i in range(0, len(body), 20_000)))
    (tmp_path / "cut.bed.gz").write_bytes(gzip.compress(body)[:300])
    (tmp_path / "named.gz").write_text("chr1\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in L.file_catalog(spark, str(tmp_path)).collect()}
    for n in ("one.bed.gz", "many.bed.gz"):
        assert got[n].format == "bed" and got[n].record_estimate == pytest.approx(60_000, rel=0.15)
    assert got["cut.bed.gz"].format == "bed" and got["named.gz"].gzip_mismatch


def test_names_of_any_kind(spark, tmp_path):
    for name in ("a b%é+.txt", "[x]{y}.txt", "q?#&=.txt", "'~!@$,;.txt"):
        (tmp_path / name).write_text("# 23andMe\nrsid\tc\tp\tg\nrs1\t1\t5\tAA\n")
    assert L.listing(spark, str(tmp_path)).count() == 4
    assert R.read_calls(spark, str(tmp_path)).count() == 4


def test_tasks_share_the_listing_of_a_tree(spark, tmp_path, monkeypatch):
    n = 0
    for a in range(6):
        for b in range(5):
            folder = tmp_path / f"d{a}" / f"k={b}" / "deep"
            folder.mkdir(parents=True)
            for i in range(4):
                (folder / f"f{i}.txt").write_text("x" * i)
                n += 1
            (folder / "_SUCCESS").write_text("")
            (folder.parent / ".f.crc").write_text("")
    whole = sorted(L.listing(spark, str(tmp_path), recursiveFileLookup="true").collect())
    assert len(whole) == n and sum(r.length for r in whole) == n // 4 * 6
    monkeypatch.setattr(ranges, "expand", lambda f, deep, pattern, e=ranges.expand: e(f, deep, pattern, 3))
    assert sorted(L.listing(spark, str(tmp_path), recursiveFileLookup="true").collect()) == whole
    assert L.listing(spark, str(tmp_path)).count() == 0
    assert L.listing(spark, str(tmp_path / "d*" / "k=1" / "deep"), pathGlobFilter="*3.txt").count() == 6
    assert L.listing(spark, str(tmp_path / "missing")).count() == 0


def test_lines_are_numbered_without_a_shuffle(spark, tmp_path, conf):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    small_splits(conf)
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    lines = L.numbered_lines(spark, str(tmp_path))
    text = plan(lines)
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    stream = text[:text.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in stream
    assert [(r.line_no, r.value) for r in lines.orderBy("line_no").collect()] == [(i + 1, f"line {i}") for i in range(500)]


def test_groups_of_files_give_the_same_rows(spark, tmp_path, conf, monkeypatch):
    for f in range(5):
        (tmp_path / f"{f}.txt").write_text("# 23andMe\nrsid\tc\tp\tg\n" + "".join(f"rs{i}\t1\t{i}\tAA\n" for i in range(60 * f)))
    small_splits(conf)
    read = lambda: (sorted(map(str, L.numbered_lines(spark, str(tmp_path)).collect())),
                    sorted(str(r) for r in R.read_calls(spark, str(tmp_path)).select("path", "rsid", "pos").collect()))
    whole = read()
    monkeypatch.setattr(L, "SPLITS_PER_GROUP", 500)
    assert len(L.file_groups(spark, str(tmp_path))) > 2
    assert read() == whole


def records(n, seed=3):
    r = random.Random(seed)
    return [(f"@r{i} x", "".join(r.choice("ACGT") for _ in range(k)), "@" * k) for i in range(n) for k in [r.randrange(1, 60)]]


@pytest.mark.parametrize("size", [10 ** 9, 9000, 300, 40])
def test_fastq_over_any_number_of_splits(spark, tmp_path, conf, size):
    recs = records(150)
    (tmp_path / "a.fq").write_text("".join(f"{h}\n{q}\n+\n{u}\n" for h, q, u in recs))
    (tmp_path / "b.fq").write_text("@only\nAC\n+\nII\n@cut\nAC\n")
    small_splits(conf, size)
    got = {}
    for r in R.read_fastq(spark, str(tmp_path)).collect():
        got.setdefault(r.path[-4:], []).append((r.read_no, r.header, r.seq, r.qual))
    assert sorted(got["a.fq"]) == [(i + 1, *r) for i, r in enumerate(recs)]
    assert got["b.fq"] == [(1, "@only", "AC", "II")]


@pytest.mark.parametrize("size", [10 ** 9, 200])
def test_fastq_ends_at_the_first_empty_quality(spark, tmp_path, conf, size):
    recs = records(60, 5)
    body = [f"{h}\n{q}\n+\n{u}\n" for h, q, u in recs]
    body[20] = "@e\n\n+\nII\n"  # an empty sequence is no end
    body[40] = "@z\nAC\n+\n\n"
    body[50] = ">wrong\nAC\n+\nII\n"  # behind the end, so it isn't read
    (tmp_path / "a.fq").write_text("".join(body))
    small_splits(conf, size)
    got = R.read_fastq(spark, str(tmp_path)).orderBy("read_no").collect()
    assert [r.read_no for r in got] == list(range(1, 41)) and got[20].seq == ""


def test_whole_fastq_records_cross_no_shuffle(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@a\nAC\n+\nII\n")
    text = R.read_fastq(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    whole = text[:text.index("Aggregate [path")]
    assert "MapInArrow" in whole and "Sort" not in whole


def test_stores_that_only_spark_opens(spark, data, monkeypatch):
    want = sorted(map(str, L.file_catalog(spark, f"{data}/me.txt").drop("path").collect()))
    calls = sorted(str(r) for r in R.read_calls(spark, f"{data}/me.txt").select("rsid", "pos").collect())
    monkeypatch.setattr(ranges, "opens", lambda spark, path: False)
    assert sorted(map(str, L.file_catalog(spark, f"{data}/me.txt").drop("path").collect())) == want
    assert sorted(str(r) for r in R.read_calls(spark, f"{data}/me.txt").select("rsid", "pos").collect()) == calls
    hidden = spark.createDataFrame([("/x/_a", 3)], "path string, length long")
    with pytest.raises(ValueError, match="/x/_a"):
        L.hidden_files(hidden)
    assert L.listing(spark, data).filter(F.col("path").endswith("me.txt")).count() == 1


def test_lines_are_written_to_a_file_for_each_name(spark, tmp_path):
    given = [(f"d{i % 3}/f{i:02}.txt", f"row {i} {j} \u00e9" if j else None) for i in range(40) for j in range(i + 1)]
    df = spark.createDataFrame(given, "name string, value string").repartition(4, "name").sortWithinPartitions("name")
    root = str(tmp_path / "out")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert ranges.write_lines(df, ranges.qualified(spark, root), "# head") == 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in {n for n, _ in given}:
        head, *lines = (tmp_path / "out" / name).read_text().removesuffix("\n").split("\n")
        assert head == "# head" and sorted(lines) == sorted(v or "" for n, v in given if n == name)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]  # nothing unfinished is left
    with pytest.raises(FileExistsError):
        ranges.write_lines(df, ranges.qualified(spark, root))
    assert ranges.write_lines(df.limit(0), ranges.qualified(spark, str(tmp_path / "none"))) == 0
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_an_export_of_many_samples_shares_few_folders(spark, monkeypatch):
    from locusgrid import catalog_io
    from locusgrid.catalog import Views

    monkeypatch.setattr(catalog_io, "EXPORT_FOLDERS", 3)
    path = catalog_io._export(Views(spark, "/root/testdata/sf0.01"), "ancestrydna")
    files = [f for _, _, names in os.walk(path) for f in names]
    assert len(files) == 100 and len(list(os.walk(path))) == 1 + 3


def test_docs_are_read_by_tasks(spark, tmp_path):
    docs = {"a b+%41.md": "x\r\ny\n", "d/\u00e9#?.md": "\u00e9\U0001F600", "_h/.i.md": "hidden", "d/e.md": "", "d/bad.md": b"a\xffb"}
    for name, text in docs.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    for path in (str(tmp_path), f"file://{tmp_path}/"):
        df = R.read_docs(spark, path)
        got = {x.doc: bytes(x.t) for x in df.select("doc", F.col("text").cast("binary").alias("t")).collect()}
        assert got == {k: v if isinstance(v, bytes) else v.encode() for k, v in docs.items()}
        assert not [f for f in df.inputFiles() if f.endswith(".md")]  # the driver has no list of the documents
