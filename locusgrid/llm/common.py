"""What the operators of this folder share: stored intermediates and rows out of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again. Later stages then start from
    files that any executor can read, and what a lost executor computed isn't computed anew."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], ddl: str,
             size: int = 4096) -> DataFrame:
    """``rows`` turns the Arrow batches of a partition into tuples of ``ddl``, one at a time."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    return df.mapInArrow(lambda it: batches_of(rows(it), schema, size), ddl)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often it is used."""
    return F.transform(F.array(value), body)[0]
