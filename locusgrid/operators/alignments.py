"""Alignments (text SAM): slices, counts, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


def slice_reads(alignments: DataFrame, rname: str, start: int, end: int) -> DataFrame:
    """Mapped reads whose reference span overlaps the 1-based inclusive window."""
    last = F.col("pos") + F.greatest(S.reference_span(F.col("cigar")), F.lit(1)) - 1
    return alignments.filter(
        (F.col("rname") == rname) & ~S.is_unmapped(F.col("flag"))
        & (F.col("pos") <= end) & (last >= start)
    )


def alignment_summary(alignments: DataFrame, groups=()) -> DataFrame:
    unmapped, dup = S.is_unmapped(F.col("flag")), S.is_duplicate(F.col("flag"))
    agg = alignments.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("read_count"),
        F.count_if(~unmapped).alias("mapped"),
        F.count_if(unmapped).alias("unmapped"),
        F.count_if(dup).alias("duplicates"),
        F.coalesce(
            F.sum(F.when(~unmapped, S.aligned_length(F.col("cigar")))), F.lit(0)
        ).alias("aligned_bases"),
    )
    return agg.withColumn(
        "duplicate_rate", F.coalesce(F.try_divide("duplicates", "read_count"), F.lit(0.0))
    )


def mean_coverage(alignments: DataFrame, contigs: DataFrame, group: str = "path") -> DataFrame:
    """Aligned bases of mapped reads over the total contig length, per file."""
    bases = alignment_summary(alignments, [group]).select(group, "aligned_bases")
    lengths = contigs.groupBy(group).agg(F.sum("length").alias("reference_length"))
    return bases.join(lengths, group).withColumn(
        "mean_coverage", F.try_divide("aligned_bases", "reference_length")
    )
