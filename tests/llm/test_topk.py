import numpy as np
import pytest
from pyspark.sql import functions as F

from locusgrid.llm import topk as K


def slow(rows, k=5, by=50):
    fine = [(i, np.floor(256 * np.array(v, float))) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, v in fine:
        if i % by == 0:
            scores = sorted((-int(v @ w), j) for j, w in fine if j != i and len(w) == len(v))[:k]
            out |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(scores)}
    return out


def search(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit(1) for c in ("id", "v", "dim", "length", "rank", "score")})
    got = K.top_k(df, F.col("id") % 50 == 0, **options).collect()
    return {(x.query_id, x.rank): (x.vec_id, x.score) for x in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(K, "BUCKET", 64)
    monkeypatch.setattr(K, "SEEDS", 30)
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(size=6) * r.choice([0.01, 1, 5, 30]) * ([4] + [0.3] * 5 if i % 3 else 1)])
            for i in range(900)]
    assert search(spark, rows, query_block=7) == slow(rows)


def test_clusters_use_both_prunings(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 8))
    rows = [(i, list((lambda v: v / np.linalg.norm(v))(centres[i % 20] + 0.05 * r.normal(size=8)))) for i in range(600)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    assert search(spark, rows) == slow(rows)


def test_odd_vectors(spark):
    one = [1.0, 0.5]
    rows = [(0, one), (50, [0.0, 0.0]), (100, None), (150, [None, 1.0]), (200, [float("nan"), 1.0]), (None, one),
            (250, [float("inf"), 1.0]), (300, []), (350, [1.0]), (1, one), (2, one), (3, one), (4, one), (5, one),
            (6, one), (400, [-1.0, -1.0])]
    assert search(spark, rows) == slow(rows)
    assert (350, 1) not in search(spark, rows)


def test_repeated_ids_and_few_rows(spark):
    got = search(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])])
    assert got == {(0, 1): (1, 131072), (0, 2): (1, 131072)}
    assert search(spark, [(0, [1.0])]) == {} and search(spark, []) == {}


def test_buckets_span_files_of_unequal_norms(spark, monkeypatch):
    monkeypatch.setattr(K, "SEEDS", 10)
    monkeypatch.setattr(K, "VECTORS_PER_FILE", 20)
    r = np.random.default_rng(5)
    # Short vectors fill the larger files, which a task reads first; the longest repeat and pack well.
    rows = [(i, [float(x) for x in (r.normal(size=8) * 0.5 if i % 4 else np.full(8, 40.0 + i % 7))]) for i in range(1000)]
    one_task = {"maxPartitionBytes": "1g", "minPartitionNum": "1", "openCostInBytes": "0"}
    for key, value in one_task.items():
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        assert search(spark, rows) == slow(rows)
    finally:
        for key in one_task:
            spark.conf.unset(f"spark.sql.files.{key}")
