"""Keyed building blocks shared by the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# About the longest list that is put into one output value.
LIST_LIMIT = 10_000


def unnest(df: DataFrame, keep, array: Column, value: str, pos: str | None = None) -> DataFrame:
    """One row per non-null array element, with its 0-based position.

    Written as an outer explode and a test on the element: a plain explode of a computed array
    makes the optimizer push ``size(array) > 0`` down to the scan, which computes the array a
    second time for every row.
    """
    out = df.select(*keep, F.posexplode_outer(array).alias(pos or "_pos", value))
    out = out.filter(F.col(value).isNotNull())
    return out if pos else out.drop("_pos")


def last_wins(df: DataFrame, keys, order: str = "line_no") -> DataFrame:
    """One row per key: the one with the highest ``order``. Aggregates map-side first, so a
    key that holds a large share of the rows reaches the reducer as one row per map task."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, the figure Spark's own broadcast rule reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    jconf = df.sparkSession._jsparkSession.sessionState().conf()
    return int(jconf.autoBroadcastJoinThreshold())


def prefilter(big: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Drop rows of ``big`` that cannot match ``keys`` before an aggregation shuffles them.
    Only done while ``keys`` is small enough for Spark to broadcast; otherwise the rows pass
    through and the join that follows does the filtering. The result is the same."""
    on = [on] if isinstance(on, str) else list(on)
    keys = keys.select(*on)
    if estimated_bytes(keys) <= broadcast_limit(big):
        return big.join(keys, on, "left_semi")
    return big


def top_per_group(df: DataFrame, groups, order, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group. Spark turns the rank filter into a map-side group limit,
    so at most ``n`` rows per group and map task are shuffled."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def value_lists(pairs: DataFrame, key: str, value: str, out: str, limit: int = LIST_LIMIT) -> DataFrame:
    """Comma-joined values per key: ``key, part_no, n_values, out``.

    Values are strings and count once per key. A key's values are dealt by hash (the first 15 hex digits
    of a value's MD5, modulo the number of parts) into parts of about ``limit / 2``, so none is dropped
    and no part grows with its key; each part is sorted. ``part_no`` is dense from 0, and the parts depend
    on the values alone, not on how Spark partitions them. A key of up to ``limit / 2`` values has one part.
    """
    pairs = pairs.select(key, value).distinct()
    sizes = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_values"))
    n_parts = F.ceil(F.col("n_values") * 2 / limit)
    hashed = F.conv(F.substring(F.md5(F.col(value).cast("binary")), 1, 15), 16, 10).cast("bigint")
    dealt = pairs.join(sizes, key).withColumn("_part", F.when(n_parts > 1, hashed % n_parts).otherwise(0))
    parts = dealt.groupBy(key, "n_values", "_part").agg(F.sort_array(F.collect_list(value)).alias("_v"))
    dense = F.row_number().over(Window.partitionBy(key).orderBy("_part")) - 1
    return parts.withColumn("part_no", dense.cast("bigint")).select(
        key, "part_no", "n_values", F.array_join("_v", ",").alias(out))


def whole_lists(pairs: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """All values of a key, sorted and comma-joined, in one row: ``key, out``.

    Values are strings and count once per key; nulls are left out. Tasks join ranges of the sorted pairs, so
    what comes together for a key is a text for each range it spans, not an element for each value.
    """
    pairs = pairs.select(key, value).filter(F.col(value).isNotNull()).distinct()
    ranges = pairs.repartitionByRange(key, value).withColumn("_range", F.spark_partition_id())
    texts = ranges.groupBy(key, "_range").agg(
        F.min(value).alias("first"), F.array_join(F.sort_array(F.collect_list(value)), ",").alias("text"))
    joined = texts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first", "text"))).alias("_t"))
    return joined.select(key, F.array_join(F.col("_t.text"), ",").alias(out))


def table_fingerprint(df: DataFrame, groups=(), columns=None) -> DataFrame:
    """Content fingerprint per group, independent of row order and partitioning.

    Each row is hashed with SHA-256; four 60-bit slices of the digests are summed, which
    aggregates map-side, and the sums with the row count are hashed once more.
    """
    groups = list(groups)
    columns = columns or [c for c in df.columns if c not in groups]
    cells = [
        F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string"))
        for c in columns
    ]
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(x, F.lit("-")) for x in cells]), 256)
    hashed = df.select(*groups, digest.alias("_h"))
    sums = [
        F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
        .cast("decimal(38,0)").alias(f"_s{i}")
        for i in range(4)
    ]
    total = hashed.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    joined = F.concat_ws(":", F.col("n_rows").cast("string"),
                         *[F.coalesce(F.col(f"_s{i}").cast("string"), F.lit("0")) for i in range(4)])
    return total.select(*groups, "n_rows", F.sha2(joined, 256).alias("fingerprint"))
