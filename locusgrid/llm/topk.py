"""Exact top-k inner products by buckets of similar length.

The vectors are stored in the order of their length, in files of even size; tasks read them in buckets
of at most ``BUCKET`` vectors. A query that needs more than theta to enter its top k needs the cosine
theta / (length of query x longest length) from a bucket. Above 1 the bucket is skipped. From
``FOCUS_FROM`` on, few vectors can reach it, so the query's largest coordinates bound the coordinates
that they may have, and only vectors within all bounds are verified. Below, the bucket's vectors that
are long enough are verified. Verifying is the product itself, so the result is exact.

Queries come in blocks of bounded size, and each block is held against all vectors. Theta starts from
products with the ``SEEDS`` longest vectors and rises with each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import map_rows, stored

BUCKET = 1024
QUERY_BLOCK = 2048
SEEDS = 2048
FOCUS = 3
FOCUS_FROM = 0.7
SLACK = 1e-9
VECTORS_PER_FILE = 65_536


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", by: int = 256) -> DataFrame:
    """(id, v, dim, length): components are floor(by * x), as doubles. Rows with a null id, and vectors
    that are null, empty or hold null or non-finite components, are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(
        F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).filter(F.coalesce(fine, F.lit(False)))
    v = F.transform("x", lambda c: F.floor(c * by).cast("double"))
    return kept.select("id", v.alias("v")).withColumn("dim", F.size("v")).withColumn(
        "length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def by_length(rows: DataFrame) -> DataFrame:
    """The vectors in files by dimension and length. Equal lengths are parted by id, so vectors that
    repeat don't gather in one file."""
    n = rows.count()
    files = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // VECTORS_PER_FILE))
    ordered = rows.repartitionByRange(files, "dim", F.col("length").desc(), "id").sortWithinPartitions(
        "dim", F.col("length").desc(), "id")
    return stored(ordered, "vectors-by-length")


class Best:
    """The k highest scores of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def theta(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (rows, candidates); -inf for none. ``ids``: one for each candidate."""
        k = self.scores.shape[1]
        if scores.shape[1] > 4 * k:  # only what reaches the k-th score of its row can enter
            cut = np.partition(scores, -k, axis=1)[:, -k]
            keep = (scores >= np.maximum(cut, self.theta()[rows])[:, None]).any(axis=0)
            scores, ids = scores[:, keep], ids[keep]
        s = np.hstack([self.scores[rows], scores])
        i = np.hstack([self.ids[rows], np.where(np.isneginf(scores), np.iinfo(np.int64).max, ids[None, :])])
        order = np.lexsort((i, -s), axis=1)[:, :k]
        self.scores[rows] = np.take_along_axis(s, order, axis=1)
        self.ids[rows] = np.take_along_axis(i, order, axis=1)


class Queries:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, theta: np.ndarray, k: int):
        self.ids, self.v, self.k, self.start = ids, vectors, k, theta
        self.length = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]

    def products(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        scores = self.v[rows] @ vectors.T
        scores[self.ids[rows][:, None] == ids[None, :]] = -np.inf  # a query's own row
        return scores

    def search(self, best: Best, ids: np.ndarray, vectors: np.ndarray, length: np.ndarray) -> None:
        """One bucket, in any order: a task may read several files, and a bucket may span their ends."""
        theta = np.maximum(best.theta(), self.start)
        theta = theta - SLACK * np.abs(theta)  # rounding never prunes; ties at theta stay
        reach = self.length * length.max()
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, theta / reach, np.where(theta > 0, np.inf, -np.inf))
        focused = np.flatnonzero((cosine >= FOCUS_FROM) & (cosine <= 1))
        plain = np.flatnonzero(cosine < FOCUS_FROM)
        if len(plain):
            # Length: what is too short for every query of the bucket isn't multiplied.
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(self.length[plain] > 0, theta[plain] / self.length[plain], -np.inf).min()
            long = length >= least
            if long.any():
                best.add(plain, self.products(plain, ids[long], vectors[long]), ids[long])
        if len(focused):
            unit = vectors / np.maximum(length, 1e-300)[:, None]
            for q in focused:
                t = cosine[q]
                inside = np.ones(len(ids), bool)
                for f in self.focus[q]:
                    x = self.unit[q, f]
                    room = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                    # From t on the feasible angle about the coordinate only shrinks while x < t.
                    high = x * t + room if x < t else 1.0
                    low = x * t - room if x > -t else -1.0
                    inside &= (unit[:, f] >= low) & (unit[:, f] <= high)
                if inside.any():
                    row = np.array([q])
                    best.add(row, self.products(row, ids[inside], vectors[inside]), ids[inside])


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["id"] for r in rows], np.int64), np.array([list(r["v"]) for r in rows], np.float64)


def search_block(index: DataFrame, rows: list, k: int, dim: int) -> DataFrame:
    """(query_id, vec_id, score) from every task: the queries ``rows`` against the vectors of ``dim``."""
    own = index.filter(F.col("dim") == dim)
    ids, vectors = _arrays(rows)
    start = Queries(ids, vectors, np.full(len(ids), -np.inf), k)
    seeds = own.orderBy(F.col("length").desc(), "id").limit(SEEDS).select("id", "v").collect()
    best = Best(len(ids), k)
    seed_ids, seed_vectors = _arrays(seeds)
    best.add(np.arange(len(ids)), start.products(np.arange(len(ids)), seed_ids, seed_vectors), seed_ids)
    held = index.sparkSession.sparkContext.broadcast(Queries(ids, vectors, best.theta(), k))

    def found(batches: Iterator[pa.RecordBatch]):
        queries = held.value
        best = Best(len(queries.ids), k)
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            values = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            names = batch.column("id").to_numpy()
            for at in range(0, len(names), BUCKET):
                part = slice(at, at + BUCKET)
                queries.search(best, names[part], values[part], lengths[part])
        for q, s, i in zip(queries.ids, best.scores, best.ids):
            for score, vec in zip(s, i):
                if score > -np.inf:
                    yield int(q), int(vec), int(score)

    return map_rows(own.select("id", "v", "length"), found, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          by: int = 256, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all other rows.

    ``is_query`` is a condition on ``id``. Ties go to the smaller vec_id. Vectors are compared with those
    of their dimension. Scores are exact below 2**53. Rows that repeat an id all are candidates of other
    queries, and none of its own; as a query the smallest vector stands for them. Left-out vectors: see
    ``scaled``. Fewer than k candidates give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    index = by_length(scaled(vectors, id_col, vector_col, by))
    asked = index.filter(is_query).groupBy("id", "dim").agg(F.min("v").alias("v"))
    asked = asked.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("dim"))).filter("nth = 1")
    asked = stored(asked.drop("nth"), "queries")
    counts = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    out = scratch_path(spark, "top-k")
    spark.createDataFrame([], "query_id long, vec_id long, score long").write.parquet(out)
    for dim, n in sorted(counts.items()):
        blocks = -(-n // query_block)
        for b in range(blocks):
            rows = asked.filter(F.col("dim") == dim).filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select(
                "id", "v").collect()
            if rows:
                search_block(index, rows, k, dim).write.mode("append").parquet(out)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(out)
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
