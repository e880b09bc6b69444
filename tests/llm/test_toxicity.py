import random
import zlib

import numpy as np
import pytest

from locusgrid.llm import toxicity as T


def corpus(n, seed):
    """Texts of made-up words; label 1 has a bad word, or a form of a bad stem, or a bad pair."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(r.randint(0, 120))]
        y = int(r.random() < 0.3)
        if y:
            bad = r.choice([["Zonk"], ["vrill" + "".join(r.choices("abcdefgh", k=3))]])
            at = r.randint(0, len(words))
            words[at:at] = bad
        rows.append((i, " ".join(words), y))
    return rows


def labels_of(spark, rows):
    return spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, docs):
    rows = corpus(1200, 4)
    known = {i: y for i, _, y in rows}
    got = T.score(docs([(i, t) for i, t, _ in rows]), labels_of(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    held = [x for x in got if x.held_out]
    assert 150 < len(held) < 330
    assert sum(x.predicted == known[x.doc_id] for x in held) / len(held) > 0.95


def test_fold_is_the_crc(spark, docs):
    import zlib

    for x in docs([(i, "") for i in range(40)]).select("doc_id", T.fold("doc_id").alias("f")).collect():
        assert x.f == zlib.crc32(str(x.doc_id).encode()) % 5


def test_held_out_labels_change_nothing(spark, docs):
    rows = corpus(150, 5)
    import zlib

    flipped = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, t, y in rows]
    a, b = (sorted((x.doc_id, x.score) for x in T.score(docs([r[:2] for r in rows]), labels_of(spark, z)).collect())
            for z in (rows, flipped))
    assert a == b


def test_a_score_does_not_depend_on_its_neighbours():
    rows = corpus(200, 6)
    model = T.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), np.array([1 + i % 4 for i, *_ in rows]))
    together = model.scores([t for _, t, _ in rows])
    alone = np.concatenate([model.scores([t]) for _, t, _ in rows])
    assert np.allclose(together, alone, atol=1e-6)
    assert model.scores([]).shape == (0,)
    assert model.scores([None])[0] == pytest.approx(model.scores([""])[0])


def test_languages_come_from_the_text():
    c = T.Chunk.of([T.words(x) for x in ("the end of it", "der Hund und die Katze", "le chat et les amis", "el perro y las")])
    assert [T.LANGUAGES[i] for i in c.languages()] == ["en", "de", "fr", "es"]


def test_odd_tables(spark, docs):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 5000)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = T.score(docs(rows), none).collect()
    assert len(got) == len(rows) and {x.predicted for x in got} == {0}
    odd = spark.createDataFrame([(1, 0, None), (None, 0, 1), (2, 0, 7), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert T.score(docs(rows), odd).filter("predicted = 1").count() == 0
    assert T.score(docs([]), odd).count() == 0
    kept = T.keep_civil(docs(rows), none)
    assert kept.count() == len(rows) and kept.columns == docs(rows).columns


def test_threshold_is_between_the_classes():
    assert 1 < T.threshold(np.array([0.0, 3.0, 1.0, 4.0]), np.array([0, 1, 0, 1])) < 3


def test_long_texts_and_repeated_labels_leave_the_sample_whole(spark, monkeypatch):
    monkeypatch.setattr(T, "TRAIN_CHARS", 50)
    rows = [(i, "x " * 400 if i % 10 == 0 else f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (4, 1)], "doc_id long, toxic int")
    got = T.training_rows(docs, labels)
    assert set(got["id"]) == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert got["text"].str.len().max() == 50
    assert got.set_index("id").label.get(4, 1) == 1
    few = T.training_rows(docs, labels, rows=10)
    assert len(few) == 20 and few["weight"].min() > 5


def test_weights_move_the_cut():
    z, y = np.array([0.0, 1, 2, 3]), np.array([0, 1, 0, 1])
    assert T.threshold(z, y, np.array([1.0, 1, 9, 1])) == 2.5 and T.threshold(z, y, np.array([1.0, 9, 1, 1])) == 0.5


def test_whole_texts_are_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(T, "TRAIN_CHARS", 200)
    rows = [(i, "calm words " * 40 + ("vile" if i % 2 else "mild")) for i in range(200)] + [(i, "x") for i in range(200, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, toxic int")
    model = T.learn(docs, labels)
    assert model.scores(["calm words " * 40 + "vile"])[0] > model.scores(["calm words " * 40 + "mild"])[0] + 0.2
    # What the driver holds stays bounded: whole texts up to 10 x 200 characters of a class.
    few = T.training_rows(docs, labels, rows=10, whole=True)
    assert set(few["text"]) <= {t for _, t in rows} and few.groupby("label")["text"].apply(lambda t: t.str.len().sum()).max() <= 2000
    assert few["weight"].min() > 5
