"""Sequences and reads: projections, summaries and quality-control tables.

``sequences`` has ``path, seq_id, sequence``; ``reads`` has ``path, read_no, seq, qual``.
Everything that needs an order over values (median, N50, quartiles, bins) works on a histogram
that is aggregated first, so no reducer sees one row per read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions import sequence as S
from ..functions import text as T
from ..session import scratch_path
from .batches import character_histogram, character_range, frame_chunks, frame_rows
from .keyed import top_per_group


# --- projections -----------------------------------------------------------

def slice_sequence(sequences: DataFrame, seq_id: str, start: int, end: int) -> DataFrame:
    """1-based inclusive substring of one sequence."""
    cut = F.substring("sequence", start, max(end - start + 1, 0))
    return sequences.filter(F.col("seq_id") == seq_id).select(
        F.lit(f"{seq_id}:{start}-{end}").alias("header"), cut.alias("sequence")
    )


def slice_sequences(sequences: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(slices, rejected)`` for many regions; a region on an unknown sequence is rejected."""
    r = regions.withColumnRenamed("chrom", "seq_id")
    joined = r.join(sequences.select("seq_id", "sequence"), "seq_id", "left")
    cut = F.substr("sequence", F.col("start1").cast("int"),
                   (F.col("end1") - F.col("start1") + 1).cast("int"))
    ok = joined.filter(F.col("sequence").isNotNull()).select(
        "seq_id", "start1", "end1", cut.alias("sequence")
    )
    return ok, joined.filter(F.col("sequence").isNull()).select("seq_id", "start1", "end1")


def fasta_table(sequences: DataFrame) -> DataFrame:
    return sequences.select(
        F.col("seq_id").alias("id"),
        F.length("sequence").cast("bigint").alias("length"),
        S.gc_percent(F.col("sequence")).alias("gc"),
        "sequence",
    )


def reads_to_sequences(reads: DataFrame) -> DataFrame:
    return reads.select("path", F.col("name").alias("header"), F.col("seq").alias("sequence"))


def translate_sequences(sequences: DataFrame, frames=(1, 2, 3, -1, -2, -3), table_id="1") -> DataFrame:
    """One protein per sequence and frame. Both strands are made once per sequence, and each is translated in its
    three frames at once."""
    keep = [c for c in sequences.columns if c != "sequence"]
    both = sequences.select(*keep, F.col("sequence").alias("_fw"), S.reverse_complement(F.col("sequence")).alias("_rc"))
    return frame_rows(both, "_fw", "_rc", frames, S.codon_table(table_id))


CHUNK = 3 << 18


def sequence_chunks(sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """``path, seq_id, length, chunk_no, start, bases`` of ``sequences`` (path, seq_id, sequence): stretches of ``size`` bases
    (a multiple of three) from ``start`` (0-based) on, and the two bases behind each. No later step holds
    a whole sequence. A sequence must be ASCII; another fails the read."""
    if size % 3:
        raise ValueError("the size of a chunk must be a multiple of three")
    plain = F.when(F.octet_length("sequence") == F.length("sequence"), F.col("sequence").cast("binary")).otherwise(
        F.raise_error(F.concat(F.lit("not an ASCII sequence: "), "seq_id")).cast("binary"))
    held = sequences.select("path", "seq_id", F.length("sequence").cast("bigint").alias("length"), plain.alias("_b"))
    # Places first, as the last explode; a cut of bytes doesn't walk the sequence from its start.
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("bigint"))
    each = held.select("path", "seq_id", "length", "_b", F.posexplode(starts).alias("chunk_no", "start"))
    cut = F.substring(F.col("_b"), (F.col("start") + 1).cast("int"), F.lit(size + 2)).cast("string")
    return each.select("path", "seq_id", "length", F.col("chunk_no").cast("bigint").alias("chunk_no"), "start", cut.alias("bases"))


def translate_chunks(chunks: DataFrame, table_id: str = "1") -> DataFrame:
    """``path, seq_id, frame, chunk_no, protein``: six frames of each chunk. The parts of a forward frame follow each other
    by chunk number, those of a reverse frame against it; joined so they are ``translate_sequences``."""
    table = S.codon_table(table_id)
    both = F.concat(frame_chunks(table, True)("bases", "start", "length"), frame_chunks(table, False)("bases", "start", "length"))
    return chunks.select("path", "seq_id", "chunk_no", F.inline(both)).select("path", "seq_id", "frame", "chunk_no", "protein")


def slice_chunks(chunks: DataFrame, regions: DataFrame, size: int = CHUNK) -> DataFrame:
    """``seq_id, start1, end1, chunk_no, bases`` for each chunk that a region (chrom, start1, end1; 1-based, inclusive) meets:
    its part of the slice. Only those chunks are joined, by sequence and number."""
    first = F.expr(f"(greatest(start1, 1) - 1) div {size}")
    r = regions.select(F.col("chrom").alias("seq_id"), "start1", "end1").filter("end1 >= greatest(start1, 1)")
    r = r.select("*", F.explode(F.sequence(first, F.expr(f"(end1 - 1) div {size}"))).alias("chunk_no"))
    own = F.substring("bases", 1, size)
    low = F.greatest(F.col("start1") - 1 - F.col("start"), F.lit(0))
    high = F.least(F.col("end1") - F.col("start"), F.lit(size))
    return chunks.join(r, ["seq_id", "chunk_no"]).select(
        "seq_id", "start1", "end1", "chunk_no", F.substr(own, (low + 1).cast("int"), (high - low).cast("int")).alias("bases"))


def chunk_summary(chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """``path, seq_id, length, gc, ambiguous_bases`` from the chunks of each sequence."""
    own = F.substring("bases", 1, size)
    return chunks.groupBy("path", "seq_id", "length").agg(
        F.sum(S.gc_count(own)).alias("_gc"), F.sum(S.ambiguous_bases(own)).alias("ambiguous_bases")).select(
        "path", "seq_id", "length", F.when(F.col("length") > 0, F.lit(100.0) * F.col("_gc") / F.col("length")).otherwise(0.0).alias("gc"),
        "ambiguous_bases")


# --- summaries over histograms ---------------------------------------------

def length_profile(hist: DataFrame, group: str = "path") -> DataFrame:
    """Per group: count, total, min, max, median (whole number) and N50, from a histogram
    ``group, length, n``. A file with D distinct lengths has at least D²/2 bases, so the
    window below stays small against the data it describes."""
    w = Window.partitionBy(group)
    run = w.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = F.col("length") * F.col("n")
    x = hist.withColumns({
        "_cum_n": F.sum("n").over(run),
        "_cum_b": F.sum(bases).over(run),
        "_n": F.sum("n").over(w),
        "_b": F.sum(bases).over(w),
    })
    low_rank = F.expr("(_n + 1) div 2")
    high_rank = F.expr("_n div 2 + 1")
    from_top = F.col("_b") - F.col("_cum_b") + bases
    agg = x.groupBy(group).agg(
        F.sum("n").alias("n_sequences"),
        F.sum(bases).alias("total_length"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.min(F.when(F.col("_cum_n") >= low_rank, F.col("length"))).alias("_lo"),
        F.min(F.when(F.col("_cum_n") >= high_rank, F.col("length"))).alias("_hi"),
        F.max(F.when(from_top * 2 >= F.col("_b"), F.col("length"))).alias("n50"),
    )
    return agg.withColumn("median_length", F.expr("(_lo + _hi) div 2")).drop("_lo", "_hi")


def _length(c: str) -> Column:
    return F.length(c).cast("bigint")


def fasta_summary(sequences: DataFrame, group: str = "path") -> DataFrame:
    """Records without bases are left out."""
    seq = F.col("sequence")
    hist = (
        sequences.filter(F.length(seq) > 0)
        .groupBy(group, _length("sequence").alias("length"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(S.gc_count(seq)).alias("gc"),
            F.sum(S.ambiguous_bases(seq)).alias("amb"),
        )
    )
    extra = hist.groupBy(group).agg(
        F.sum("gc").alias("_gc"), F.sum("amb").alias("ambiguous_bases")
    )
    return (
        length_profile(hist, group).join(extra, group)
        .withColumn("mean_length", F.col("total_length") / F.col("n_sequences"))
        .withColumn("gc_percent", F.lit(100.0) * F.col("_gc") / F.col("total_length"))
        .drop("_gc")
    )


def n50(sequences: DataFrame, group: str = "path") -> DataFrame:
    hist = sequences.filter(F.length("sequence") > 0).groupBy(
        group, _length("sequence").alias("length")
    ).agg(F.count(F.lit(1)).alias("n"))
    return length_profile(hist, group).select(group, "n50")


def _adapter_found(adapters) -> Column:
    hit = F.lit(False)
    for a in adapters:
        hit = hit | F.col("seq").contains(a)
    return hit


def head_sample(reads: DataFrame, n: int) -> DataFrame:
    """First ``n`` reads of every file, by their place in the file."""
    return reads.filter(F.col("read_no") <= n)


def adapter_hits(reads: DataFrame, adapters=K.ADAPTERS, head: int | None = None,
                 group: str = "path") -> DataFrame:
    """Reads with an adapter among all reads, or among the first ``head`` of every file."""
    scanned = reads if head is None else head_sample(reads, head)
    return scanned.groupBy(group).agg(
        F.count_if(_adapter_found(adapters)).alias("adapter_hits"),
        F.count(F.lit(1)).alias("sampled_reads"),
    )


def quality_range(reads: DataFrame, group: str = "path") -> DataFrame:
    """Per file: lowest and highest quality character, the offset they imply, and whether the
    range leaves the encoding open."""
    codes = reads.select(group, character_range("qual").alias("_c"))
    agg = codes.groupBy(group).agg(F.min("_c.low").alias("min_code"), F.max("_c.high").alias("max_code"))
    lo, hi = F.col("min_code"), F.col("max_code")
    return agg.withColumns({
        "phred_offset": S.phred_offset(lo, hi),
        "ambiguous": S.phred_ambiguous(lo, hi),
    })


def fastq_summary(reads: DataFrame, adapters=K.ADAPTERS, head: int | None = None,
                  group: str = "path") -> DataFrame:
    """Per file; adapters are counted in all reads, or in the first ``head``."""
    coded = reads.filter(F.length("qual") > 0).select(
        group, "seq", "read_no", character_range("qual").alias("_c")
    )
    sampled = F.lit(True) if head is None else F.col("read_no") <= head
    hist = coded.groupBy(group, _length("seq").alias("length")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_c.total").alias("q"),
        F.sum("_c.n").alias("qn"),
        F.min("_c.low").alias("lo"),
        F.max("_c.high").alias("hi"),
        F.count_if(sampled & _adapter_found(adapters)).alias("ad"),
        F.count_if(sampled).alias("sm"),
    )
    extra = hist.groupBy(group).agg(
        F.sum("q").alias("_q"), F.sum("qn").alias("_qn"),
        F.min("lo").alias("_lo"), F.max("hi").alias("_hi"),
        F.sum("ad").alias("adapter_hits"), F.sum("sm").alias("sampled_reads"),
    )
    offset = S.phred_offset(F.col("_lo"), F.col("_hi"))
    return (
        length_profile(hist, group).join(extra, group)
        .withColumnRenamed("n_sequences", "read_count")
        .withColumn("mean_length", F.col("total_length") / F.col("read_count"))
        .withColumn("phred_offset", offset)
        .withColumn("mean_quality", F.col("_q") / F.col("_qn") - F.col("phred_offset"))
        .drop("_q", "_qn", "_lo", "_hi", "n50", "total_length")
    )


def base_histogram(reads: DataFrame, group: str = "path") -> DataFrame:
    """``group, cycle (0-based), code, n, n_inside``: quality characters per cycle, with the
    part that lies inside the sequence. The size is cycles x characters per file; so is what a task shuffles."""
    sized = reads.select(group, F.length("seq").alias("_l"), "qual")
    return character_histogram(sized, group, "qual", "_l")


def _with_offset(hist: DataFrame, group: str) -> DataFrame:
    rng = hist.groupBy(group).agg(F.min("code").alias("_lo"), F.max("code").alias("_hi"))
    rng = rng.select(group, S.phred_offset(F.col("_lo"), F.col("_hi")).alias("_offset"))
    return hist.join(rng, group)


def per_base_mean_quality(reads: DataFrame, group: str = "path") -> DataFrame:
    """Mean quality per cycle; characters past the end of the sequence are ignored."""
    agg = base_histogram(reads, group).groupBy(group, "cycle").agg(
        F.sum(F.col("code") * F.col("n_inside")).alias("_s"), F.sum("n_inside").alias("n_reads"),
        F.min("code").alias("_lo"), F.max("code").alias("_hi"))
    offsets = agg.groupBy(group).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).select(
        group, S.phred_offset(F.col("_lo"), F.col("_hi")).alias("_offset"))
    return agg.join(offsets, group).filter(F.col("n_reads") > 0).select(
        group, F.col("cycle").cast("bigint").alias("cycle"), "n_reads",
        (F.col("_s") / F.col("n_reads") - F.col("_offset")).alias("mean_quality"),
    )


def qc_per_base_box(reads: DataFrame, cycles: int | None = None, group: str = "path") -> DataFrame:
    """Quartiles and whiskers (last value within 1.5 IQR of the box) per cycle, outliers left
    out. Characters past the end of the sequence count here. All cycles, or the first ``cycles``."""
    hist = _with_offset(_kept(base_histogram(reads, group), "base-histogram"), group)
    hist = (hist if cycles is None else hist.filter(F.col("cycle") < cycles)).select(
        group, "cycle", (F.col("code") - F.col("_offset")).alias("q"), "n"
    )
    quart = hist.groupBy(group, "cycle").agg(
        F.percentile("q", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("_p"),
        F.sum("n").alias("n_reads"),
    ).select(
        group, "cycle", "n_reads", F.col("_p")[0].alias("q1"), F.col("_p")[1].alias("median"),
        F.col("_p")[2].alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    inside_lo = F.col("q") >= F.col("q1") - 1.5 * iqr
    inside_hi = F.col("q") <= F.col("q3") + 1.5 * iqr
    ends = hist.join(quart, [group, "cycle"]).groupBy(
        group, "cycle", "n_reads", "q1", "median", "q3"
    ).agg(F.min(F.when(inside_lo, F.col("q"))).alias("_lo"), F.max(F.when(inside_hi, F.col("q"))).alias("_hi"))
    return ends.select(
        group, F.col("cycle").cast("bigint").alias("cycle"), "n_reads", "q1", "median", "q3",
        F.least(F.coalesce(F.col("_lo").cast("double"), F.col("q1")), F.col("q1")).alias("whisker_low"),
        F.greatest(F.coalesce(F.col("_hi").cast("double"), F.col("q3")), F.col("q3")).alias("whisker_high"),
    )


def equal_bins(values: DataFrame, value: str, n: str, group: str, bins: int = K.QC_BINS,
               low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts over equal bins of pre-aggregated ``value, n``; the top edge is inclusive and a
    single value sits in a unit-wide range. Empty bins give no row."""
    if low is None:
        rng = values.groupBy(group).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
        one = F.col("_a") == F.col("_b")
        rng = rng.select(
            group,
            F.when(one, F.col("_a") - 0.5).otherwise(F.col("_a").cast("double")).alias("_lo"),
            F.when(one, F.col("_b") + 0.5).otherwise(F.col("_b").cast("double")).alias("_hi"),
        )
        values = values.join(rng, group)
    else:
        values = values.withColumns({"_lo": F.lit(float(low)), "_hi": F.lit(float(high))})
    raw = F.floor((F.col(value) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))
    bin_no = F.least(raw, F.lit(bins - 1)).cast("bigint")
    return values.groupBy(group, bin_no.alias("bin")).agg(F.sum(n).alias("n_reads"))


def _qc_reads(reads: DataFrame) -> DataFrame:
    return reads.filter((F.length("seq") > 0) & (F.length("qual") > 0))


def qc_read_quality_hist(reads: DataFrame, group: str = "path") -> DataFrame:
    """40 bins of mean read quality. Reads collapse to (sum, length) pairs first; the encoding
    offset shifts values and edges alike, so it does not change a bin."""
    # Counted, not filtered: a filter on computed reads computes them once more below it. Stored, because the edges
    # of the bins and the bins both come from it.
    coded = reads.select(group, (F.length("seq") > 0).alias("_in"), character_range("qual").alias("_c"))
    sums = coded.groupBy(group, F.col("_c.total").alias("_s"), F.col("_c.n").alias("_l")).agg(F.count_if("_in").alias("n"))
    sums = _kept(sums.filter("n > 0 and _l > 0"), "quality-sums")
    means = sums.select(group, (F.col("_s") / F.col("_l")).alias("q"), "n")
    return equal_bins(means, "q", "n", group)


def qc_length_hist(reads: DataFrame, group: str = "path") -> DataFrame:
    lengths = _qc_reads(reads).groupBy(group, _length("seq").alias("length")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return equal_bins(lengths, "length", "n", group)


def qc_gc_hist(reads: DataFrame, group: str = "path") -> DataFrame:
    """40 bins of GC percentage (two decimals) on [0, 100]. Reads collapse to (GC, length)
    pairs first."""
    pairs = _qc_reads(reads).groupBy(
        group, S.gc_count(F.col("seq")).alias("_g"), F.length("seq").alias("_l")
    ).agg(F.count(F.lit(1)).alias("n"))
    pct = pairs.select(
        group, T.fixed_round(F.lit(100.0) * F.col("_g") / F.col("_l"), 2).alias("gc"), "n"
    )
    return equal_bins(pct, "gc", "n", group, low=0.0, high=100.0)


def qc_n_content(reads: DataFrame, group: str = "path") -> DataFrame:
    """Percentage of N per cycle of the sequence."""
    bases = character_histogram(_qc_reads(reads), group, "seq")
    is_n = F.col("code").isin(ord("N"), ord("n"))
    agg = bases.groupBy(group, "cycle").agg(
        F.sum("n").alias("n_reads"), F.sum(F.when(is_n, F.col("n")).otherwise(0)).alias("n_count"))
    return agg.select(
        group, F.col("cycle").cast("bigint").alias("cycle"), "n_reads", "n_count",
        (F.lit(100.0) * F.col("n_count") / F.col("n_reads")).alias("n_pct"),
    )


def qc_totals(reads: DataFrame, group: str = "path") -> DataFrame:
    agg = _qc_reads(reads).groupBy(group).agg(
        F.count(F.lit(1)).alias("reads"),
        F.sum(_length("seq")).alias("bases"),
        F.sum(S.n_count(F.col("seq"))).alias("n_bases"),
    )
    return agg.withColumn("n_rate", F.lit(100.0) * F.col("n_bases") / F.col("bases"))


def stored_reads(reads: DataFrame, group: str = "path") -> DataFrame:
    """``group, read_no, seq, qual`` of ``reads``, stored: for tables that read them more than once. Reads that a view
    computes are so computed once; a filter on them is applied to the stored ones."""
    return _kept(reads.select(group, "read_no", "seq", "qual"), "reads")


def overrepresented(reads: DataFrame, n: int = K.TOP_SEQUENCES, group: str = "path", stored: bool = False) -> DataFrame:
    """Most frequent exact sequences per file; ties go to the one seen first. The sequences are read twice or more, so
    they are stored first unless the reads are (``stored``)."""
    if not stored:
        scored = F.when(F.length("qual") > 0, F.lit("#")).alias("qual")  # all that is asked of it
        reads = stored_reads(reads.select(group, "read_no", "seq", scored), group)
    return top_texts(_qc_reads(reads), group, n, F.xxhash64("seq"))


def top_texts(reads: DataFrame, group: str, n: int, digest: Column) -> DataFrame:
    """``group, seq, n_reads, first_read, rank``: counted by ``digest`` first, which is all that is shuffled of a text;
    then the texts of the ``n`` first digests of each file are fetched and counted as they are.

    A digest counts at least as much, and is first seen as early, as any text that has it. Where texts share one
    of these digests, the n-th best text so far is a bound: all digests up to it are looked at as well.
    """
    rows = reads.select(group, "seq", "read_no", digest.alias("_d"))
    counts = rows.groupBy(group, "_d").agg(F.count(F.lit(1)).alias("_n"), F.min("read_no").alias("_first"))
    top = top_per_group(counts, [group], [F.col("_n").desc(), F.col("_first")], n, "_rank").select(group, "_d")
    texts = _kept(_texts_of(rows, _kept(top, "top-digests"), group), "top-digest-texts")
    order = [F.col("n_reads").desc(), F.col("first_read").asc()]
    best = _kept(top_per_group(texts, [group], order, n), "top-texts")
    shared = texts.groupBy(group, "_d").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if not shared.isEmpty():
        last = best.groupBy(group).agg(F.max_by(F.struct("n_reads", "first_read"), "rank").alias("_b"))
        near = (F.col("_n") > F.col("_b.n_reads")) | ((F.col("_n") == F.col("_b.n_reads")) & (F.col("_first") <= F.col("_b.first_read")))
        more = _kept(counts.join(last, group).filter(near).select(group, "_d"), "more-digests")
        best = top_per_group(_texts_of(rows, more, group), [group], order, n)
    return best.drop("_d")


def _texts_of(rows: DataFrame, digests: DataFrame, group: str) -> DataFrame:
    """Counts of the texts that have one of ``digests`` (few for each group)."""
    return rows.join(digests, [group, "_d"], "left_semi").groupBy(group, "seq").agg(
        F.count(F.lit(1)).alias("n_reads"), F.min("read_no").alias("first_read"), F.first("_d").alias("_d"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A few rows for each file, stored, so that their size is known to the joins that use them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
