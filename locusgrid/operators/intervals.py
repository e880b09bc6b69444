"""Genomic intervals, 0-based half-open: slices, projections, summaries, overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as E
from .keyed import value_lists

# Bin widths of the overlap join, fine to coarse.
BIN_WIDTHS = (1 << 14, 1 << 20, 1 << 26)
# An interval goes to the finest width at which it touches no more bins than this.
MAX_BINS = 64


def slice_bed(features: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Half-open rows that overlap the 1-based inclusive window."""
    return features.filter(
        (F.col("chrom") == chrom) & (F.col("start0") < end) & (F.col("end0") > start - 1)
    )


def slice_gff(features: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Closed 1-based rows (``start1, end1``) that overlap the window."""
    return features.filter(
        (F.col("chrom") == chrom) & (F.col("start1") <= end) & (F.col("end1") >= start)
    )


def bed_to_gff(features: DataFrame) -> DataFrame:
    """BED rows as the nine GFF columns; an unnamed row is named after its line."""
    name = F.coalesce("name", F.concat(F.lit("region_"), F.col("line_no").cast("string")))
    return features.select(
        F.col("chrom").alias("seqid"),
        F.lit("bed2gff").alias("source"),
        F.lit("region").alias("feature_type"),
        E.to_one_based(F.col("start0")).alias("start1"),
        F.col("end0").alias("end1"),
        F.coalesce("score", F.lit(".")).alias("score"),
        F.coalesce("strand", F.lit(".")).alias("strand"),
        F.lit(".").alias("phase"),
        F.concat(F.lit("ID="), name).alias("attributes"),
    )


def gff_to_bed(features: DataFrame) -> DataFrame:
    """GFF or GTF rows as the six BED columns."""
    return features.select(
        "chrom",
        E.to_zero_based(F.col("start1")).alias("start0"),
        F.col("end1").alias("end0"),
        E.feature_name(F.col("attributes")).alias("name"),
        "score",
        "strand",
    )


def feature_summary(features: DataFrame, groups=()) -> DataFrame:
    """Feature count per type."""
    return features.groupBy(*groups, "feature_type").agg(F.count(F.lit(1)).alias("n_features"))


def span_by_chrom(features: DataFrame, groups=()) -> DataFrame:
    return features.groupBy(*groups, "chrom").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum(F.col("end0") - F.col("start0")).alias("span")
    )


def feature_sources(features: DataFrame, group: str) -> DataFrame:
    """Sorted distinct sources per group."""
    return value_lists(features.select(group, "source").distinct(), group, "source", "sources")


def _shifted(c: Column, width: int) -> Column:
    return F.shiftright(c, width.bit_length() - 1)


def _level(start: Column, end: Column, widths) -> Column:
    """Index of the bin width an interval is filed under."""
    out = F.lit(len(widths) - 1)
    for i in reversed(range(len(widths) - 1)):
        touched = _shifted(end - 1, widths[i]) - _shifted(start, widths[i]) + 1
        out = F.when(touched <= MAX_BINS, F.lit(i)).otherwise(out)
    return out


def _bins(start: Column, end: Column, widths) -> Column:
    """``struct<lvl, bin>`` of every bin a half-open interval touches at its own width; none if it is empty."""
    def at(level):
        width = _by_level(level, lambda i: F.lit(widths[i].bit_length() - 1), widths)
        bins = F.sequence(_shift_by(start, width), _shift_by(end - 1, width))
        return F.transform(bins, lambda b: F.struct(level.alias("lvl"), b.alias("bin")))

    return F.when(end > start, at(_level(start, end, widths)))


def _by_level(level: Column, value, widths) -> Column:
    out = value(len(widths) - 1)
    for i in reversed(range(len(widths) - 1)):
        out = F.when(level == i, value(i)).otherwise(out)
    return out


def _shift_by(c: Column, bits: Column) -> Column:
    return F.call_function("shiftright", c.cast("bigint"), bits)


def _lookups(point: Column, widths) -> Column:
    """``struct<lvl, bin>`` of the one bin that holds a point, at every width."""
    return F.array(*[
        F.struct(F.lit(i).alias("lvl"), _shifted(point.cast("bigint"), w).alias("bin")) for i, w in enumerate(widths)])


def _filed_and_looked(df: DataFrame, filed: Column, filed_tag: int, points: Column) -> DataFrame:
    """One row for each bin an interval is filed under and each bin its start is looked up in."""
    def tagged(bins, tag):
        return F.transform(bins, lambda b: F.struct(F.lit(tag).alias("tag"), b["lvl"].alias("lvl"), b["bin"].alias("bin")))

    both = F.concat(tagged(points, 1 - filed_tag), F.coalesce(tagged(filed, filed_tag), F.slice(tagged(points, 0), 1, 0)))
    return df.select("*", F.explode_outer(both).alias("_b")).filter(F.col("_b").isNotNull()).select(
        *df.columns, F.col("_b.tag").alias("_tag"), F.col("_b.lvl").alias("_lvl"), F.col("_b.bin").alias("_bin"))


def _widest(df: DataFrame, start: Column, end: Column) -> int:
    """The longest span of an interval table; 0 if none has a length."""
    return df.agg(F.max(end.cast("bigint") - start.cast("bigint"))).first()[0] or 0


def overlap_join(left: DataFrame, right: DataFrame, chrom: str = "chrom",
                 left_span=("start0", "end0"), right_span=("start0", "end0"), widths=BIN_WIDTHS) -> DataFrame:
    """All overlapping pairs of two interval tables (inner), on half-open spans.

    Where no interval can touch more than ``MAX_BINS`` bins of the finest width, which one aggregation over the
    spans of each table tells, both sides are filed under the bins they touch there. A pair counts in the one
    bin that holds the later of its starts, so a short interval is one row of the join on either side.

    Else intervals are of many lengths. Of two that overlap, exactly one holds the other's start: the left
    start lies in the right interval (tag 0), or the right start lies inside the left one, behind its start
    (tag 1). So intervals are filed under the bins they touch, at one width each (64 bins at most, or the
    chromosome length over the coarsest width), and starts are looked up in their one bin at every
    width. Both kinds meet in a single equi-join on (chrom, tag, width, bin), where a pair comes once.

    In both cases nothing has to be deduplicated, and a row of any length is a bounded number of rows on either
    side. A crowded bin is a skewed key of a join that no aggregation follows, which adaptive execution splits.
    Rows with a null or empty span match nothing. The left columns and the right columns, except its
    ``chrom``, must have distinct names. ``widths`` are powers of two, fine to coarse; fewer of them
    mean fewer lookups per row.
    """
    ls, le = (F.col(c) for c in left_span)
    rs, re_ = (F.col(c) for c in right_span)
    left, right = left.filter(le > ls), right.filter(re_ > rs)
    if max(_widest(left, ls, le), _widest(right, rs, re_)) <= (MAX_BINS - 1) * widths[0]:
        return _short_join(left, right, chrom, (ls, le), (rs, re_), widths[0])
    looked = _filed_and_looked(left, _bins(ls + 1, le, widths), 1, _lookups(ls, widths))
    filed = _filed_and_looked(right, _bins(rs, re_, widths), 0, _lookups(rs, widths))
    pairs = looked.join(filed, [chrom, "_tag", "_lvl", "_bin"])
    holds = F.when(F.col("_tag") == 0, (rs <= ls) & (ls < re_)).otherwise((ls < rs) & (rs < le))
    return pairs.filter(holds).drop("_tag", "_lvl", "_bin")


def _short_join(left: DataFrame, right: DataFrame, chrom: str, left_span, right_span, width: int) -> DataFrame:
    (ls, le), (rs, re_) = left_span, right_span

    def filed(df, start, end):
        return df.select("*", F.explode(F.sequence(
            _shifted(start.cast("bigint"), width), _shifted(end.cast("bigint") - 1, width))).alias("_bin"))

    pairs = filed(left, ls, le).join(filed(right, rs, re_), [chrom, "_bin"])
    first = _shifted(F.greatest(ls.cast("bigint"), rs.cast("bigint")), width) == F.col("_bin")
    return pairs.filter((ls < re_) & (rs < le) & first).drop("_bin")
