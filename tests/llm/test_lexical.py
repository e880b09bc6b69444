import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusgrid.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(docs, items, k=10):
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = set()
    for item, terms in asked.items():
        rows = []
        for doc, c in found:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t, times in terms.items() if t in c)
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out |= {(item, rank + 1, r[3], -r[0]) for rank, r in enumerate(sorted(rows, key=lambda r: r[:3])[:k])}
    return out


def search(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("docs", "sizes", "score", "nth", "rank")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("item", "doc_id", "nth")})
    return [tuple(r) for r in X.ranked(d, i, **options).collect()]


def some(seed, n=400):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(300)]
    text = lambda most: " ".join(r.choice(words) for _ in range(r.randrange(1, most)))
    return [(i, text(60)) for i in range(n)], [(i, text(20)) for i in range(12)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(X, "BATCH", 5)
    docs, items = some(seed)
    got = search(spark, docs, items, segment_tokens=700, block_bytes=300)
    assert len(got) == len(set(got)) and set(got) == slow(docs, items)


def test_more_than_64_terms_and_copies(spark):
    docs, _ = some(5)
    long = " ".join(f"w{i}" for i in range(150)) + " w3 w3 only"
    docs += [(1000 + i, "only w3 w99 w120") for i in range(40)]
    items = [(1, long), (2, "only"), (3, "missing")]
    assert set(search(spark, docs, items)) == slow(docs, items)


def test_groups_are_left_unscored():
    r = np.random.default_rng(0)
    tokens, sizes, docs = [], [], []
    for i in range(3000):
        own = [b"often"] * 2 + ([b"rare"] * 3 if i % 100 == 0 else [b"mid"] * (i % 3)) + [b"x%d" % r.integers(50)] * 5
        tokens += own
        sizes.append(len(own))
        docs.append(i)
    names = ("docs", "sizes", "terms", "ends", "at", "tf")
    segment = X.Segment(dict(zip(names, X._segment(docs, sizes, tokens))))
    known = X.Statistics(3000, len(tokens), {b"often": 3000, b"rare": 30, b"mid": 2000})
    best = X.Best(10)
    scored = X.search(segment, known.length(segment.sizes), [(b"often", 1), (b"rare", 1), (b"mid", 1)], known.weight, best)
    assert len(best.rows) == 10 and scored <= 100
    assert all(doc % 100 == 0 for _, doc in best.rows)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "-- .."), (4, "Ab ab É1"), (4, "Ab ab É1"), (None, "ab"), (5, "é1 \x00x"), (6, "zz " * 60_000 + "ab"),
            (7, "q"), (8, "q"), (9, "q"), (10, "q"), (11, "q")]
    items = [(1, "AB É1"), (2, None), (3, "?"), (None, "ab"), (7, "ab"), (7, "zz zz"), (None, "é1")]
    got = search(spark, docs, items)
    assert sorted(got, key=str) == sorted([*slow(docs, items), *[r for r in got if got.count(r) > 1]], key=str)
    assert {r[0] for r in got} == {1, None, 7}
    ranks = [r[1] for r in got if r[0] == 1]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_empty_tables(spark):
    docs, items = some(9, 20)
    assert search(spark, [], items) == [] and search(spark, docs, []) == []


def test_lengths_past_64_bits_are_exact():
    known = X.Statistics(10 ** 12, 3 * 10 ** 14, {})
    sizes = np.array([10 ** 7, 5], np.int64)
    assert known.length(sizes).tolist() == [25 + 75 * int(s) * 10 ** 12 // (3 * 10 ** 14) for s in sizes]
