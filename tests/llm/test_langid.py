import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusgrid.llm import langid as L


def plain_phrases(text: list, held: list) -> int:
    """Cross-parsing by looking each phrase up in the labelled text."""
    joined = "".join(map(chr, held))
    s, at, n = "".join(map(chr, text)), 0, 0
    while at < len(s):
        size = 1
        while at + size < len(s) and s[at:at + size + 1] in joined:
            size += 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_phrases_equal_a_plain_search(seed):
    r = random.Random(seed)
    some = lambda n: "".join(r.choice("abcd é.") for _ in range(n))
    sample = (("x", (some(60), some(40))), ("y", ("ab" * 30,)), ("z", ()))
    model = L.Languages(sample)
    texts = [some(r.randrange(0, 90)) + r.choice(["", "q", "qq"]) + some(r.randrange(0, 9)) for _ in range(60)]
    stretches = [model.codes(t) for t in texts]
    got = model.phrases(stretches)
    for row, (_, held) in zip(got, sample):
        codes = [int(c) for t in held for c in model.symbol[L.letters(" " + t + " ")]]
        assert row.tolist() == [plain_phrases([int(c) for c in s], codes) for s in stretches]


def test_letters_and_parts(monkeypatch):
    assert "".join(map(chr, L.letters("  Aß1,2É-ı"))) == "\0aß\0é\0ı"
    model = L.Languages((("x", ("abc def",)),))
    text = "ab -- 12 c.D" * 9 + "...." + "ef"
    whole = model.codes(text).tolist()
    for part in (1, 2, 3, 5):
        monkeypatch.setattr(L, "PART", part)
        assert model.codes(text).tolist() == whole


def corpus():
    r = random.Random(4)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(30))
    rows = [(i, make(["the", "ing", "er"]) if i % 3 else make(["ieux", "ou", "éa"]), "en" if i % 3 else "fr") for i in range(300)]
    return rows


def identify(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {c: F.lit("clash") for c in ("h", "ok", "one", "n", "held_out", "lang_pred", "score", "phrases")})
    return L.identify(df, **options).collect()


def test_held_out_accuracy_and_fold(spark):
    rows = corpus()
    truth = {i: lang for i, _, lang in rows}
    got = identify(spark, rows)
    assert len(got) == 300 and all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_held_out_labels_and_ids_teach_nothing(spark):
    rows = corpus()
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    other = [(i, t, "xx" if fold(i) else lang) for i, t, lang in rows]
    key = lambda rs: sorted((r.doc_id, r.lang_pred, r.score) for r in rs)
    assert key(identify(spark, rows)) == key(identify(spark, other))


def test_odd_rows(spark):
    rows = corpus() + [(900, None, "en"), (901, "", "en"), (902, "12 -- 3", "fr"), (None, "therthe ing", None), (903, "ing", None),
                       (903, "ing", None), (904, "語語", None), (905, "therthe ing " * 30_000, "en")]
    got = {}
    for r in identify(spark, rows):
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[902][0].score == 0 and got[900][0].phrases is None
    assert got[None][0].lang_pred == "en" and not got[None][0].held_out
    assert [r.lang_pred for r in got[903]] == ["en", "en"]
    assert got[904][0].lang_pred == "en"  # nothing matches: the language with more labelled texts
    assert got[905][0].lang_pred == "en"


def test_no_labels_and_no_rows(spark):
    assert [r.lang_pred for r in identify(spark, [(1, "abc", None)])] == ["und"]
    assert identify(spark, []) == []


def test_copies_and_long_texts_dont_crowd_out_the_sample(spark):
    rows = corpus() + [(1000 + i, "ou " * 50_000, "fr") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = dict(L.sample_of(df, F.lit(True), "text", "lang", train_docs=20, train_chars=40))
    assert {k: len(v) for k, v in sample.items()} == {"en": 20, "fr": 20}
    assert max(len(t) for v in sample.values() for t in v) == 40 and len(set(sample["fr"])) == 20


def test_a_small_sample_doesnt_win_by_its_size(spark):
    got = identify(spark, corpus() + [(5000, "qu", "la")])
    assert {r.lang_pred for r in got if r.doc_id != 5000} == {"en", "fr"}
    assert np.isfinite([r.score for r in got]).all()
