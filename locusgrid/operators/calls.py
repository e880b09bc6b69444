"""Genotype calls: lookup, slicing, projection to variant rows, summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import genotype as G
from ..session import fixed_rows
from .keyed import last_wins, prefilter

_REGION = re.compile(r"([^:]+):(\d+)-(\d+)")


def parse_region(region: str) -> tuple[str, int, int]:
    """``chrom:start-end``, 1-based inclusive."""
    m = _REGION.fullmatch(region)
    if not m:
        raise ValueError(f"region must be chrom:start-end, got {region!r}")
    return m.group(1), int(m.group(2)), int(m.group(3))


def parse_regions(df: DataFrame, column: str = "region") -> DataFrame:
    """Adds ``chrom, start1, end1`` (null where the text has another shape) and ``valid``."""
    c = F.col(column)
    shape = r"^([^:]+):([0-9]+)-([0-9]+)$"
    ok = c.rlike(shape)

    def part(i: int) -> Column:
        return F.when(ok, F.regexp_extract(c, shape, i))

    return df.withColumns({
        "chrom": part(1),
        "start1": part(2).try_cast("bigint"),
        "end1": part(3).try_cast("bigint"),
        "valid": ok,
    })


def slice_calls(calls: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    pos = F.col("pos").try_cast("bigint")
    return calls.filter((F.col("chrom") == chrom) & pos.between(start, end))


def project_columns(df: DataFrame, columns) -> DataFrame:
    """The requested columns in the requested order; anything unknown is refused."""
    columns = [c.strip() for c in columns if c.strip()]
    if not columns:
        raise ValueError("needs a non-empty column list")
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(
            f"unknown column(s): {','.join(unknown)}; available columns: {','.join(df.columns)}"
        )
    return df.select(*columns)


def id_list(spark: SparkSession, arg: str | list[str]) -> DataFrame:
    """Requested ids ``(req_no, rsid)``, order and repeats kept. ``arg`` is a comma list or a
    sequence of lines (first word each, ``#`` comments ignored)."""
    if isinstance(arg, str):
        ids = [x.strip() for x in arg.split(",") if x.strip()]
    else:
        stripped = (line.strip() for line in arg)
        ids = [line.split()[0] for line in stripped if line and not line.startswith("#")]
    return fixed_rows(spark, list(enumerate(ids, 1)), "req_no bigint, rsid string")


def requests_per_sample(samples: DataFrame, ids: list[str]) -> DataFrame:
    """``(sample_id, req_no, rsid)``: a short list of ids asked of every sample."""
    listed = F.array(*[F.lit(i) for i in ids])
    return samples.select("sample_id", F.posexplode(listed).alias("_p", "rsid")).select(
        "sample_id", (F.col("_p") + 1).cast("bigint").alias("req_no"), "rsid"
    )


def lookup_calls(requests: DataFrame, calls: DataFrame, keys=("rsid",)) -> DataFrame:
    """Requests (order and repeats kept) with the last call per key; ``not_tested`` if none."""
    keys = list(keys)
    wanted = prefilter(calls, requests, keys)
    hits = last_wins(wanted.select(*keys, "chrom", "pos", "genotype", "line_no"), keys).select(
        *keys, F.col("chrom").alias("_chrom"), F.col("pos").alias("_pos"),
        F.col("genotype").alias("_gt"),
    )
    return requests.join(hits, keys, "left").select(
        *requests.columns,
        F.coalesce("_chrom", F.lit("")).alias("chrom"),
        F.coalesce(F.col("_pos").cast("string"), F.lit("")).alias("pos"),
        F.coalesce("_gt", F.lit(K.NOT_TESTED)).alias("genotype"),
    )


def _with_sites(calls: DataFrame, site_map: DataFrame) -> DataFrame:
    sites = site_map.select(
        "rsid", F.col("chrom").alias("ref_chrom"), F.col("pos").alias("ref_pos"), "ref", "alt"
    )
    return calls.join(sites, "rsid", "left").withColumn("_alleles", G.split_alleles(F.col("genotype")))


def calls_to_vcf(calls: DataFrame, site_map: DataFrame, group: str = "sample_id") -> DataFrame:
    """Mapped, called sites as VCF columns on the reference coordinates. ``site_map`` has one
    row per rsID (see ``last_wins``); ids outside it and no-calls give no row."""
    return (
        _with_sites(calls, site_map)
        .filter(F.col("ref").isNotNull() & (F.size("_alleles") > 0))
        .select(
            group, "line_no",
            F.col("ref_chrom").alias("chrom"), F.col("ref_pos").alias("pos"),
            F.col("rsid").alias("id"), "ref", "alt",
            F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), F.lit(".").alias("info"),
            F.lit("GT").alias("format"),
            G.gt_code(F.col("_alleles"), F.col("ref"), F.col("alt")).alias("gt"),
        )
    )


def conversion_accounting(calls: DataFrame, site_map: DataFrame, group: str = "sample_id") -> DataFrame:
    """Per group: emitted, unmapped (counted before the no-call test) and no-call rows."""
    unmapped = F.col("ref").isNull()
    empty = F.size("_alleles") == 0
    return _with_sites(calls, site_map).groupBy(group).agg(
        F.count_if(~unmapped & ~empty).alias("emitted"),
        F.count_if(unmapped).alias("unmapped"),
        F.count_if(~unmapped & empty).alias("no_call_skipped"),
    )


def calls_summary(calls: DataFrame, group: str = "sample_id") -> DataFrame:
    no_call = G.is_no_call(F.col("genotype"), "summary")
    return calls.groupBy(group).agg(
        F.count(F.lit(1)).alias("snp_count"),
        F.count_if(no_call).alias("no_calls"),
    ).withColumn("no_call_rate", F.col("no_calls") / F.col("snp_count"))


def calls_by_chrom(calls: DataFrame, group: str = "sample_id") -> DataFrame:
    return calls.groupBy(group, "chrom").agg(F.count(F.lit(1)).alias("n_calls"))
