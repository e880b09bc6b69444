"""Variant records: slices, counts, report tables, site maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import variant as V
from .keyed import top_per_group, unnest


def slice_variants(variants: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Records whose reference bases overlap the 1-based inclusive window."""
    last = F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1
    return variants.filter(
        (F.col("chrom") == chrom) & (F.col("pos") <= end) & (last >= start)
    )


def classify(variants: DataFrame) -> DataFrame:
    ref, alt, sv = F.col("ref"), F.col("alt"), F.col("svtype")
    return variants.withColumns({
        "variant_class": V.variant_class(ref, alt, sv),
        "report_class": V.report_class(ref, alt, sv),
        "is_pass": V.is_pass(F.col("filter")),
    })


def variant_summary(variants: DataFrame, groups=()) -> DataFrame:
    """Counts by class (sites without ALT count in the total only), filter state and the
    transition/transversion ratio, null when there is no transversion."""
    c = F.col("variant_class")
    sub = F.when(c == "snv", V.substitution(F.col("ref"), F.col("alt")))
    counted = classify(variants).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("variant_count"),
        *[F.count_if(c == k).alias(k) for k in ("snv", "indel", "mnp", "sv")],
        F.count_if(sub == "ts").alias("transitions"),
        F.count_if(sub == "tv").alias("transversions"),
        F.count_if(F.col("is_pass")).alias("pass_count"),
        F.count_if(~F.col("is_pass")).alias("filtered_count"),
    )
    return counted.withColumn("ts_tv_ratio", F.try_divide("transitions", "transversions"))


def variants_by_chrom(variants: DataFrame, groups=()) -> DataFrame:
    return variants.groupBy(*groups, "chrom").agg(F.count(F.lit(1)).alias("n_variants"))


def variant_report_counts(variants: DataFrame, groups=()) -> DataFrame:
    """Long metric/value table of the report profile."""
    c, ok = F.col("report_class"), F.col("is_pass")
    kinds = ("snv", "indel", "mnp", "sv")
    wide = classify(variants).groupBy(*groups).agg(
        *[F.count_if(c == k).alias(k) for k in kinds],
        F.count_if(ok).alias("pass"),
        F.count_if(~ok).alias("filtered"),
    )
    return wide.unpivot(list(groups), [*kinds, "pass", "filtered"], "metric", "value")


def _listing(variants: DataFrame, *extra) -> DataFrame:
    return variants.select(
        "chrom", "pos", F.coalesce("id", F.lit(".")).alias("id"), "ref",
        V.first_alt(F.col("alt")).alias("alt"), *extra,
    )


def top_quality(variants: DataFrame, n: int = K.TOP_VARIANTS, groups=()) -> DataFrame:
    """Best ``n`` by quality, ties broken by every other column, all descending."""
    rows = variants.select(
        *groups, F.coalesce("qual", F.lit(0.0)).alias("qual"), "chrom", "pos",
        F.coalesce("id", F.lit(".")).alias("id"), "ref", V.first_alt(F.col("alt")).alias("alt"),
    )
    order = [F.col(c).desc() for c in ("qual", "chrom", "pos", "id", "ref", "alt")]
    if groups:
        return top_per_group(rows, groups, order, n)
    return rows.orderBy(*order).limit(n)


def frameshift_candidates(variants: DataFrame) -> DataFrame:
    return _listing(variants.filter(V.is_frameshift(F.col("ref"), F.col("alt"))))


def filtered_out(variants: DataFrame) -> DataFrame:
    return _listing(variants.filter(~V.is_pass(F.col("filter"))), "filter")


def snv_first_alt(sites: DataFrame) -> DataFrame:
    """First ALT only, single-base REF and ALT only."""
    first = F.substring_index("alt", ",", 1)
    return sites.withColumn("alt", first).filter((F.length("ref") == 1) & (F.length("alt") == 1))


def chip_union(*id_tables: DataFrame) -> DataFrame:
    """Distinct rsIDs over several manifests."""
    out = id_tables[0].select("rsid")
    for t in id_tables[1:]:
        out = out.unionByName(t.select("rsid"))
    return out.distinct()


def chip_sites(sites: DataFrame, chip: DataFrame) -> DataFrame:
    """Single-base sites whose rsID is on the chip, as site-map rows."""
    kept = snv_first_alt(sites).select(F.col("id").alias("rsid"), "chrom", "pos", "ref", "alt")
    return kept.join(chip.select("rsid"), "rsid", "left_semi")


def chip_coverage(site_rows: DataFrame, chip: DataFrame) -> DataFrame:
    """Rows written, chip size and the percentage (0 for an empty chip)."""
    written = site_rows.agg(F.count(F.lit(1)).alias("written"), F.lit(1).alias("_k"))
    size = chip.select("rsid").distinct().agg(F.count(F.lit(1)).alias("chip_size"), F.lit(1).alias("_k"))
    return written.join(size, "_k").select(
        "written", "chip_size",
        F.when(F.col("chip_size") > 0, F.col("written") * 100.0 / F.col("chip_size"))
        .otherwise(F.lit(0.0)).alias("coverage_pct"),
    )


def flatten_info(variants: DataFrame, keys) -> DataFrame:
    """One string column per INFO key: the value, ``True`` for a bare flag, else empty. A key that is
    repeated takes its last value; missing members of a list (``.``) are left out."""
    cols = {}
    for k in keys:
        last = F.try_element_at(_entries(k), F.lit(-1))
        value = known_members(F.substr(last, F.lit(len(k) + 2)))
        cols[k] = F.when(last.isNull(), F.lit("")).when(last == k, F.lit("True")).otherwise(value)
    return variants.withColumns(cols) if cols else variants


def _entries(key: str) -> Column:
    return F.filter(F.split("info", ";"), lambda x: (x == key) | x.startswith(key + "="))


def known_members(value: Column) -> Column:
    """A list without its missing members; ``.`` alone is empty."""
    return F.when(value.contains("."), F.array_join(F.filter(
        F.split(value, ","), lambda x: x != "."), ",")).otherwise(value)


def explode_samples(variants: DataFrame, samples) -> DataFrame:
    """Long form ``…, sample, key, value`` of the per-sample FORMAT fields. A missing value is
    empty; a missing genotype allele is ``.``."""
    named = F.array(*[
        F.struct(F.lit(s).alias("sample"), F.get("sample_values", F.lit(i)).alias("raw"))
        for i, s in enumerate(samples)
    ])
    by_sample = unnest(variants, ["*"], named, "_s")
    fields = F.arrays_zip(
        F.split("format", ":").alias("key"), F.split("_s.raw", ":").alias("value")
    )
    long = unnest(by_sample, ["*"], fields, "_f").filter(F.col("_f.key").isNotNull())
    raw = F.coalesce(F.col("_f.value"), F.lit("."))
    gt = F.when(raw == ".", F.lit("./.")).otherwise(raw)
    value = F.when(F.col("_f.key") == "GT", gt).otherwise(known_members(raw))
    keep = [c for c in variants.columns if c not in ("format", "sample_values")]
    return long.select(*keep, F.col("_s.sample").alias("sample"), F.col("_f.key").alias("key"),
                       value.alias("value"))


def flatten_format(variants: DataFrame, samples, keys) -> DataFrame:
    """Wide form: one ``<sample>.<key>`` column per sample and FORMAT key."""
    order = F.split("format", ":")
    cols = []
    for i, s in enumerate(samples):
        values = F.split(F.get("sample_values", F.lit(i)), ":")
        for k in keys:
            at = F.array_position(order, k)
            got = F.when(at > 0, F.get(values, at.cast("int") - 1))
            if k == "GT":
                v = F.when(got.isNull() | (got == "."), F.lit("./.")).otherwise(got)
            else:
                v = F.coalesce(known_members(got), F.lit(""))
            cols.append(v.alias(f"{s}.{k}"))
    keep = [c for c in variants.columns if c not in ("format", "sample_values")]
    return variants.select(*keep, *cols)
