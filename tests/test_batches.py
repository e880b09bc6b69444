"""Counts over Arrow batches, and texts counted by digest, against plain loops."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusgrid.functions.sequence import codon_table
from locusgrid.operators import batches as B
from locusgrid.operators import sequences as S
from locusgrid.plans import jobs

ROWS = [("a", "II5", 2), ("a", None, 3), ("a", "", 0), ("b", "é~I", 9), (None, "xy", 1), ("b", "z" * 400, 400), ("a", "I\U0001F600", 1),
        ("b", "I", None)]


def slow(rows):
    n, inside = Counter(), Counter()
    for g, text, length in rows:
        for i, c in enumerate(text or ""):
            n[g, i, ord(c)] += 1
            inside[g, i, ord(c)] += i < (length or 0)
    return {k: (v, inside[k]) for k, v in n.items()}


@pytest.mark.parametrize("characters, cells", [(1 << 21, 1 << 23), (7, 1 << 23), (3, 512), (1000, 256)])
def test_character_histogram(spark, monkeypatch, characters, cells):
    r = random.Random(2)
    rows = ROWS + [(r.choice("abc"), "".join(r.choice("ACGTN") for _ in range(r.randrange(30))), r.randrange(40)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, t string, l int")
    # Workers import the module afresh, so its bounds travel in the closure's globals.
    monkeypatch.setattr(B, "CHARACTERS", characters)
    monkeypatch.setattr(B, "CELLS", cells)
    got = {(x.g, x.cycle, x.code): (x.n, x.n_inside) for x in B.character_histogram(df, "g", "t", "l").collect()}
    assert got == slow(rows)


@pytest.mark.parametrize("characters, cells", [(7, 1 << 23), (3, 512), (1000, 256)])
def test_counts_at_their_bounds(monkeypatch, characters, cells):
    """The same within one process, where the bounds hold for sure."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(B, "CELLS", cells)
    r = np.random.default_rng(1)
    schema = pa.schema([("group", pa.string()), ("cycle", pa.int32()), ("code", pa.int32()), ("n", pa.int64()), ("n_inside", pa.int64())])
    counts, parts, want = B.Counts(schema), [], Counter()
    for _ in range(30):
        g = str(r.integers(3))
        cycles, codes, inside = r.integers(0, 40, characters), r.integers(30, 300, characters), r.random(characters) < 0.5
        parts += list(counts.add(g, cycles, codes, inside))
        for c, k, i in zip(cycles.tolist(), codes.tolist(), inside.tolist()):
            want[g, c, k, "n"] += 1
            want[g, c, k, "in"] += i
    parts += list(counts.flush())
    got = Counter()
    for p in parts:
        for x in p.to_pylist():
            got[x["group"], x["cycle"], x["code"], "n"] += x["n"]
            got[x["group"], x["cycle"], x["code"], "in"] += x["n_inside"]
    assert got == want


def test_groups_keep_their_type(spark):
    df = spark.createDataFrame([(1, "ab"), (None, "b")], "g long, t string")
    out = B.character_histogram(df, "g", "t")
    assert dict(out.dtypes) == {"g": "bigint", "cycle": "int", "code": "int", "n": "bigint", "n_inside": "bigint"}
    assert {(r.g, r.cycle, r.code, r.n, r.n_inside) for r in out.collect()} == {(1, 0, 97, 1, 1), (1, 1, 98, 1, 1), (None, 0, 98, 1, 1)}


def test_character_range(spark):
    texts = [t for _, t, _ in ROWS]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", B.character_range("t").alias("c"))
    got = {r.i: tuple(r.c) for r in df.collect()}
    for i, t in enumerate(texts):
        codes = list(map(ord, t or ""))
        assert got[i] == (sum(codes), len(codes), min(codes, default=None), max(codes, default=None))


def test_what_leaves_a_task_is_counts(spark):
    df = spark.range(20_000).select(F.lit("f").alias("path"), F.col("id").alias("read_no"), F.lit("ACGT" * 5).alias("seq"),
                                    F.lit("I" * 20).alias("qual"))
    hist = S.base_histogram(df)
    assert hist.count() == 20
    metrics = hist._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in metrics and "MapInArrow" in metrics


@pytest.mark.parametrize("modulo", [None, 1, 3, 50])
def test_top_texts_with_shared_digests(spark, modulo):
    r = random.Random(9)
    rows = [(r.choice("xy"), i, f"t{int(r.paretovariate(0.7)) % 90}") for i in range(900)] + [("z", 1, "one"), ("z", 2, "two")]
    df = spark.createDataFrame(rows, "path string, read_no long, seq string")
    digest = F.xxhash64("seq") if modulo is None else F.pmod(F.xxhash64("seq"), F.lit(modulo))
    got = {(x.path, x["rank"]): (x.seq, x.n_reads, x.first_read) for x in S.top_texts(df, "path", 7, digest).collect()}
    want = {}
    for g in "xyz":
        counts, first = Counter(), {}
        for p, i, t in rows:
            if p == g:
                counts[t] += 1
                first.setdefault(t, i)
        best = sorted(counts, key=lambda t: (-counts[t], first[t]))[:7]
        want |= {(g, k + 1): (t, counts[t], first[t]) for k, t in enumerate(best)}
    assert got == want


def row_wise(df, table_id="1"):
    """Proteins by the column expressions, one frame at a time."""
    from locusgrid.functions import sequence as X

    return {(x.seq_id, f): x.p for f in (1, 2, 3, -1, -2, -3)
            for x in df.select("seq_id", X.translate_frame(F.col("sequence"), f, table_id).alias("p")).collect()}


def some_sequences(spark, odd=True):
    r = random.Random(4)
    rows = [("f", f"s{i}", "".join(r.choice("ACGTUNacgtnRY-") for _ in range(r.randrange(70)))) for i in range(60)]
    rows += [("f", "none", ""), ("f", "one", "A"), ("f", "six", "ATGTAA")] + ([("f", "odd", "ATGßATGéA")] if odd else [])
    return spark.createDataFrame(rows, "path string, seq_id string, sequence string")


@pytest.mark.parametrize("table_id", ["1", "2"])
def test_translation_equals_the_expressions(spark, table_id):
    df = some_sequences(spark)
    got = {(x.seq_id, x.frame): x.protein for x in S.translate_sequences(df, table_id=table_id).collect()}
    assert got == row_wise(df, table_id)


@pytest.mark.parametrize("size", [3, 9, 30, 3000])
def test_chunks_join_to_whole_sequences(spark, size):
    df = some_sequences(spark, odd=False)
    chunks = S.sequence_chunks(df, size)
    parts = {}
    for x in S.translate_chunks(chunks).collect():
        parts.setdefault((x.seq_id, x.frame), []).append((x.chunk_no, x.protein))
    got = {k: "".join(p for _, p in sorted(v, reverse=k[1] < 0)) for k, v in parts.items()}
    assert got == row_wise(df)
    whole = {x.seq_id: x.sequence for x in df.collect()}
    summary = {x.seq_id: (x.length, x.gc, x.ambiguous_bases) for x in S.chunk_summary(chunks, size).collect()}
    want = {x.id: (x.length, x.gc) for x in S.fasta_table(df).collect()}
    assert {k: v[:2] for k, v in summary.items()} == want
    regions = spark.createDataFrame([("s1", 1, 5), ("s2", 4, 40), ("s3", 60, 90), ("nope", 1, 2), ("six", 2, 2), ("six", 5, 4)],
                                    "chrom string, start1 long, end1 long")
    cut = {}
    for x in S.slice_chunks(chunks, regions, size).collect():
        cut.setdefault((x.seq_id, x.start1, x.end1), []).append((x.chunk_no, x.bases))
    joined = {k: "".join(b for _, b in sorted(v)) for k, v in cut.items()}
    for name, a, z in [("s1", 1, 5), ("s2", 4, 40), ("s3", 60, 90), ("six", 2, 2)]:
        assert joined.get((name, a, z), "") == whole[name][a - 1:z]
    assert not set(joined) & {("nope", 1, 2), ("six", 5, 4)}


def test_a_long_sequence_translates_by_chunks(spark):
    unit = "ATGGCCTAACGTTTGACNATG"
    df = spark.range(1).select(F.lit("f").alias("path"), F.lit("long").alias("seq_id"), F.repeat(F.lit(unit), 200_000).alias("sequence"))
    chunks = S.sequence_chunks(df, 3 * 7 * 10_000)
    got = S.translate_chunks(chunks).groupBy("frame").agg(F.sum(F.length("protein")).alias("n")).collect()
    n = len(unit) * 200_000
    assert {r.frame: r.n for r in got} == {f: (n - abs(f) + 1) // 3 for f in (1, 2, 3, -1, -2, -3)}
    first = S.translate_chunks(chunks).filter("frame = 1 and chunk_no = 3").first().protein
    assert first == "MA*RLXM" * 10_000


def test_non_ascii_chunks_are_refused(spark):
    with pytest.raises(Exception, match="not an ASCII sequence: odd"):
        S.sequence_chunks(some_sequences(spark), 30).collect()


def test_frames_are_handed_on_before_a_whole_batch_is_translated(spark, monkeypatch):
    texts = [pa.array(["ACGT" * n for n in (1, 5, 1000, 0, 3)] + [None])]
    monkeypatch.setattr(B, "STRANDS", 100)
    assert list(B.strand_slices(texts)) == [(0, 2), (2, 1), (3, 3)]
    monkeypatch.undo()
    long = "ACGTTGCAAN" * 40_000
    rows = [(i, "r", s) for i, s in enumerate([long, None, "", "AC", "acguaé", long[3:]])]
    got = S.translate_sequences(spark.createDataFrame(rows, "id long, path string, sequence string"), frames=(2, -1, 1)).collect()
    assert [(r.id, r.path, r.frame) for r in got] == [(i, "r", f) for i in range(6) for f in (2, -1, 1)]
    numbers, aminos = B.base_numbers(), B.codon_numbers(codon_table("1"))
    one = [p.decode() for p in B.proteins(np.frombuffer(long.encode(), np.uint8), numbers, aminos)]
    assert (got[0].protein, got[2].protein) == (one[1], one[0]) and len(got[1].protein) == len(one[0])
    assert [r.protein for r in got if r.id == 1] == [None] * 3 and {r.protein for r in got if r.id in (2, 3)} == {""}


def test_chunks_of_a_stretch_are_translated_at_once(monkeypatch):
    calls, plain = [], B.code_points
    monkeypatch.setattr(B, "code_points", lambda texts: calls.append(len(texts)) or plain(texts))
    bases, n = ["ACGTTTAN", "", None, "AC", "acgUGATTACA"] * 200, 1000
    for forward in (True, False):
        translated = B.frame_chunks(codon_table("1"), forward).func
        whole = translated(pa.array(bases), pa.array([300] * n), pa.array([900] * n))
        assert calls == [n]
        monkeypatch.setattr(B, "STRANDS", 50)
        assert translated(pa.array(bases), pa.array([300] * n), pa.array([900] * n)) == whole and sum(calls) == 2 * n
        monkeypatch.undo()
        monkeypatch.setattr(B, "code_points", lambda texts: calls.append(len(texts)) or plain(texts))
        calls.clear()
        assert [len(x["protein"]) for x in whole[0].as_py()] == [2, 2, 2] and whole[1].as_py()[0]["protein"] == ""


def test_reads_are_computed_once_for_their_tables(spark):
    def tables(name):
        seen = spark.sparkContext.accumulator(0)

        @F.udf("string")
        def counted(text):
            seen.add(1)
            return text

        df = spark.createDataFrame([(i, "ACGT" * (i % 7), "I" * (4 * (i % 7))) for i in range(70)], "read_no long, seq string, qual string")
        reads = df.select(F.lit("a").alias("path"), "read_no", counted("seq").alias("seq"), counted("qual").alias("qual"))
        got = {"top": S.overrepresented, "quality": S.qc_read_quality_hist, "box": S.qc_per_base_box, "all": jobs.qc_report_tables}[name](reads)
        found = got if name == "all" else {name: got}
        plans = "".join(x._jdf.queryExecution().analyzed().toString() for x in found.values())
        rows = {k: sorted(x.collect()) for k, x in found.items()}
        return rows, plans.count("counted("), seen.value

    top, left, n = tables("top")
    assert sorted((r.seq, r.n_reads, r.first_read) for r in top["top"]) == [("ACGT" * i, 10, i) for i in range(1, 7)]
    assert left == 0 and n == 140  # each text once
    hist, left, _ = tables("quality")
    assert [(r.bin, r.n_reads) for r in hist["quality"]] == [(20, 60)] and left == 0
    box, left, _ = tables("box")
    assert len(box["box"]) == 24 and left == 0
    every, left, _ = tables("all")
    assert left == 0 and every["overrepresented"] == top["top"] and every["read_quality"] == hist["quality"]
    assert every["per_base_quality"] == box["box"]
