import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from locusgrid.llm import positional as P

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(doc, items, window=13):
    words, hit, found = word_list(doc), set(), set()
    for item, text in items:
        own = word_list(text)
        k = min(window, len(own))
        windows = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1):
            if own and tuple(words[i:i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("clash"))


def sample(seed, n, most):
    r = random.Random(seed)
    return [" ".join(r.choices(["the", "of", "a", "Bee", "ç-d", "x1"], k=r.randint(0, most))) for _ in range(n)]


def test_words_are_the_contracts():
    for t in [None, "", "A-b_c", "É é 1a", "\x7f|~a{b}", "日本 語"]:
        assert [w.decode() for w in P.words(t)] == word_list(t)


def test_hits_match_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT_TOKENS", 2000)
    texts = sample(1, 60, 60)
    items = list(enumerate(sample(2, 12, 4) + [" ".join(t.split()[2:25]) for t in texts[:8]])) + [(50, None), (51, "--")]
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, None), (91, ""), (1, texts[1]), (None, texts[2])]
    got = P.decontaminate(docs(rows), items_of(spark, items + [(None, "the of")]), window=5).collect()
    want = sorted(str((i, *slow(t, items, 5))) for i, t in rows)
    assert want == sorted(str((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated)) for x in got)


def test_blocks_give_the_same(spark, docs, monkeypatch):
    texts = sample(3, 30, 50)
    items = [(i, " ".join(t.split()[:20])) for i, t in enumerate(texts[:9])]
    rows = [(i % 25, t) for i, t in enumerate(texts)]
    one = sorted(map(str, P.decontaminate(docs(rows), items_of(spark, items)).drop("runs").collect()))
    monkeypatch.setattr(P.blocks, "__defaults__", (120,))
    several = sorted(map(str, P.decontaminate(docs(rows), items_of(spark, items)).drop("runs").collect()))
    assert one == several and len(list(P.blocks(items_of(spark, items), "item_id", "text"))) > 1


def test_phrases_do_not_cross_documents(spark, docs):
    got = P.decontaminate(docs([(1, "a b c"), (2, "d e f")]), items_of(spark, [(1, "c d")])).collect()
    assert {x.n_hit for x in got} == {0}


def test_proximity(spark, docs):
    index = P.build_index(docs([(1, "red x x blue"), (2, "blue y red"), (3, "red " + "z " * 50 + "blue"), (4, "red")]))
    got = P.proximity(index, [("i", [b"red", b"blue"])], within=4).collect()
    assert sorted(x.doc_id for x in got) == [1, 2]


def test_proximity_of_three_words_against_brute_force(spark, docs):
    import random

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("a b c d e f g h".split()[:rng.randrange(3, 9)]) for _ in range(rng.randrange(0, 25)))) for i in range(200)]
    items = [("abc", [b"a", b"b", b"c"]), ("ah", [b"a", b"h"]), ("gg", [b"g", b"g"]), ("hgfe", [b"h", b"g", b"f", b"e"]), ("none", [b"q", b"a"])]

    def close(text, terms, within):
        w = text.split()
        return any(set(terms) <= set(w[i:i + within + 1]) for i in range(len(w)))

    for within in (2, 5):
        want = sorted((i, name) for i, text in rows for name, terms in items if close(text, [t.decode() for t in terms], within))
        for size in (40, 1 << 20):
            got = P.proximity(P.build_index(docs(rows), segment_tokens=size), items, within).collect()
            assert sorted((x.doc_id, x.item) for x in got) == want and len(want) > 100
    # The rare word may lie between the others, each at the full distance from it no longer counts.
    index = P.build_index(docs([(1, "b x x x x a x x x x c")]))
    assert P.proximity(index, items[:1], 5).count() == 0 and P.proximity(index, items[:1], 10).count() == 1
    with pytest.raises(ValueError):
        P.proximity(index, items, P.GAP)


def test_keep_clean(spark, docs):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, item + " more"), (1, item), (2, "clean text"), (None, "no name"), (3, item + " z" * 400), (4, None)]
    kept = P.keep_clean(docs(rows), items_of(spark, [(7, item)]))
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["2", "3", "4", "None"]
    assert kept.columns == docs(rows).columns
    assert P.keep_clean(docs([]), items_of(spark, [(7, item)])).count() == 0
    assert P.keep_clean(docs(rows), items_of(spark, [])).count() == len(rows)


@pytest.mark.parametrize("turned", [False, True])
def test_an_item_id_with_two_window_lengths(spark, docs, turned):
    a = [f"a{i}" for i in range(13)]
    text = " ".join(a + ["x", "y", "z"] + ["p q r"])
    items = [(7, " ".join(a)), (7, "p q r")]
    frame = spark.createDataFrame(items[::-1] if turned else items, "item_id long, text string")
    got = P.decontaminate(docs([(1, text)]), frame).first()
    assert (got.n_words, got.n_hit, got.n_items) == (19, 16, 1)


def test_hits_are_no_more_than_words(spark, docs):
    r = random.Random(11)
    some = lambda n: " ".join(r.choice("abc") for _ in range(n))
    rows = [(i, some(r.randrange(1, 60))) for i in range(60)]
    items = spark.createDataFrame([(i % 4, some(r.choice([2, 5, 13, 20]))) for i in range(20)], "item_id long, text string")
    for x in P.decontaminate(docs(rows), items).collect():
        assert 0 <= x.n_hit <= x.n_words
