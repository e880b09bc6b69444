import gzip
import hashlib
import io
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locusgrid.llm import warc as W

PAGES = "page_id long, url string, html string"


def slow(rows):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        top = max(ids) if ids and len(data) >= 1000 and len(groups[html or ""]) > 1 else None
        back = top is not None and (i is None or i < top)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if back else "response", top if back else None))
    return sorted(map(str, out))


def test_round_trip(spark):
    trap = "x" * 1500 + "\r\n\r\nWARC/1.1\r\n\r\nfiledesc://a 0 0 0 3\n\r\nContent-Length: 1\r\n"
    rows = [(1, "http://a b/é\n", trap), (2, None, trap), (7, "u", trap), (7, "u", trap), (None, "z", trap), (3, "q", None),
            (4, "", ""), (5, "k", "é" * 600), (6, "k", "é" * 600), (8, "k", "é" * 499), (9, "k", "é" * 499),
            (10, "k", "a" * 999), (11, "k", "a" * 999), (12, "k", "a" * 1000), (13, "k", "a" * 1000)]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("winner", "type", "uri", "payload")})
    got = W.archive_pages(df).collect()
    assert slow(rows) == sorted(str(tuple(x)[:5]) for x in got)
    assert sorted(str((x.page_id, x.url)) for x in got) == sorted(str((i, u)) for i, u, _ in rows)
    assert W.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_small_archives_hold_everything(spark, tmp_path):
    rows = [(i, "u", f"page {i} " + "y" * i) for i in range(200)]
    archives = W.arc_archives(spark.createDataFrame(rows, PAGES), most=2000, compress=False)
    assert archives.count() > 10
    heads = {bytes(x.content).split(b"\n")[1][:1] for x in archives.collect()}
    assert heads == {b"1", b"2"}
    got = W.convert(archives).collect()
    assert sorted(x.payload_bytes for x in got) == sorted(len(h) for _, _, h in rows)
    assert {x.date for x in got} == {"2024-01-01T00:00:00Z"} and {x.type for x in got} == {"response"}
    again = W.convert(archives).collect()
    assert sorted(x.record_id for x in again) == sorted(x.record_id for x in got)


def test_other_arc_lines():
    one = (b"filedesc://x 0.0.0.0 2001 text/plain 75\n1 0 o\nURL IP-address Archive-date Content-type Archive-length\n"
           + b"\n" * 13)
    head = one.index(b"1 0 o")
    one = one[:head].replace(b" 75\n", b" %d\n" % len(one[head:])) + one[head:]
    data = one + b"http://h/with space 1.2.3.4 20010203040506 image/gif 3\nabc\n\n" + b"dns:h 1.2.3.4 2001 text/dns 0\n\n"
    got = list(W.arc_records("x", data))
    assert [(f["URL"], c) for f, c in got] == [("http://h/with space", b"abc"), ("dns:h", b"")]
    assert W.iso_date("20010203040506") == "2001-02-03T04:05:06Z"


@pytest.mark.parametrize("tail", [b"http://h 1.2.3.4 2001 a/b 9\nabc", b"too few fields\n", b"http://h 1 2 a/b x\n"])
def test_malformed_records_are_errors(tail):
    head = W.arc_head("x", 1)
    with pytest.raises(ValueError):
        list(W.arc_records("x", head + tail))
    with pytest.raises(ValueError):
        list(W.arc_records("x", tail))


def test_repeated_rows_have_identifiers_of_their_own(spark, tmp_path):
    html = "r" * 2000
    pages = spark.createDataFrame([(5, "u", html)] * 4 + [(1, "u", html)] * 3, PAGES).repartition(3)
    got = W.archive_pages(pages, str(tmp_path / "w")).collect()
    assert sorted((x.page_id, x.record_type, x.refers_to) for x in got) == (
        [(1, "revisit", 5)] * 3 + [(5, "response", None)] * 4)
    read = W.read_warc(spark, str(tmp_path / "w")).collect()
    assert len({x.record_id for x in read}) == 7
    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*")]
    targets = {h.get("WARC-Refers-To") for f in files for h, _ in W.parse_warc(f)} - {None}
    assert len(targets) == 1 and targets <= {x.record_id for x in read if x.type == "response"}


def test_compressed_archives_hold_the_same(spark):
    rows = [(i, "u", f"page {i} " + "y" * (i * 37 % 5000)) for i in range(300)] + [(300, "long", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, PAGES)
    plain, packed = (W.arc_archives(pages, most=200_000, compress=c) for c in (False, True))
    a, b = ({bytes(x.name, "ascii").removesuffix(b".gz"): bytes(x.content) for x in df.collect()} for df in (plain, packed))
    assert a.keys() == b.keys() and all(v.startswith(W.GZIP) for v in b.values())
    sizes = [sorted((x.uri, x.payload_digest) for x in W.convert(df).collect()) for df in (plain, packed)]
    assert sizes[0] == sizes[1] and len(sizes[0]) == 301
    name, data = next(iter(b.items()))
    whole = list(W.arc_records("x", data))
    # Version 2's offsets are those of the gzip members.
    for fields, content in whole:
        if "Offset" in fields:
            assert gzip.GzipFile(fileobj=io.BytesIO(data[int(fields["Offset"]):])).readline().startswith(b"page://")
    with pytest.raises(ValueError):
        list(W.arc_records("x", data[:-5]))
    with pytest.raises(ValueError):
        list(W.arc_records("x", data[:len(data) // 2] + b"junk" + data[len(data) // 2:]))
