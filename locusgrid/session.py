"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the operators count on; all are also Spark's own defaults except the first.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster use the session you are given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("locusgrid")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it. Only a local session, whose
    executors share the driver's disk, may name none and gets a temporary one; a cluster without one is
    refused, because its executors would each write to their own disk. The setting isn't changed."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return _local_dir()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder path of the shared folder, not yet created."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before CPU-heavy work, when the source splits into fewer tasks than
    there are cores (a single small file). A source that is already split finely is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def fixed_rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A short fixed table as literals. Unlike ``createDataFrame`` it has a known, small size, so
    Spark broadcasts it instead of shuffling the other side of a join."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    structs = [
        F.struct(*[F.lit(value).cast(kind).alias(name) for value, (name, kind) in zip(row, fields)])
        for row in rows
    ]
    return spark.sql("select 1 as _one").select(F.inline(F.array(*structs)))
